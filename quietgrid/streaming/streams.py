"""The stream forms: the batch operators where they hold no state, watermarked aggregates, and keyed state.

Late data: event time with a watermark (ten minutes unless told otherwise), append mode, late rows dropped.
Gates, adapters, aggregates over annotations and redaction are row-wise, so the functions of
``operators.observe`` and ``functions.text`` apply to a stream as they are.

Keyed state is typed (``transformWithState``) and kept in RocksDB, outside the heap.  It ends by timers of event time:
once the watermark is so far on that no row to come can ask for it, a key's state is cleared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

DELAY = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_TIME = "row_event_time"


def _stateful(sdf: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType, mode: str = "Append", time: str = "EventTime") -> DataFrame:
    """The output of a processor over the rows of each key; its state is kept by a store that can hold it."""
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return sdf.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, time)


def _timed(sdf: DataFrame, ms: str, delay: str) -> DataFrame:
    return sdf.where(F.col(ms).isNotNull()).withColumn(EVENT_TIME, F.timestamp_millis(ms)).withWatermark(EVENT_TIME, delay)


def _end_at(handle: StatefulProcessorHandle, at: int) -> None:
    """The key's one timer, moved."""
    for timer in handle.listTimers():
        handle.deleteTimer(timer)
    handle.registerTimer(at)


class _Limit(StatefulProcessor):
    """Keeps rows ``period`` after the last one kept; the state is the time of that row, until the watermark is a period on."""

    def __init__(self, ms: str, period: int, order: list[str], keep: list[str]):
        self.ms, self.period, self.order, self.keep = ms, period, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        times, last, at, kept = own[self.ms].to_numpy(np.int64), self.last.get(), 0, []
        begins = last[0] + self.period if last else None
        while True:  # on to the first row that is late enough
            at = at if begins is None else max(at, int(np.searchsorted(times, begins)))
            if at >= len(times):
                break
            kept.append(at)
            begins = int(times[at]) + self.period
            at += 1
        if kept:
            self.last.update((int(times[kept[-1]]),))
            _end_at(self.handle, int(times[kept[-1]]) + self.period)
        yield own.iloc[kept][self.keep]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limit_stream(sdf: DataFrame, key: str, ms: str, period_ms: int, tie: str | None = None, delay: str = DELAY) -> DataFrame:
    """Rows at least ``period_ms`` after the last row kept of their key; an older row is dropped, and so is one without a time.

    Rows of one micro-batch are taken in order of time, then of ``tie``.  A key's state ends when the watermark
    has passed its last row kept by the period: every row to come would be kept.
    """
    return _stateful(_timed(sdf, ms, delay), [key], _Limit(ms, period_ms, [ms] if tie is None else [ms, tie], sdf.columns), sdf.schema)


class _Trail(StatefulProcessor):
    """Counts and sums over the rows of a trailing window, which are held as a list of pieces; a batch adds its own, and the list is written anew when half of it is too old.

    A call of the state costs more than the rows of most keys, so a key has few of them however long its rows last.
    """

    PIECE = 10_000  # rows in one entry of the list

    def __init__(self, key: str, ms: str, value: str, window: int, order: list[str], keep: list[str]):
        self.key, self.ms, self.value, self.window, self.order, self.keep = key, ms, value, window, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "times array<long>, vals array<double>")

    def _pieces(self, times: np.ndarray, values: np.ndarray) -> list[tuple]:
        return [(times[i : i + self.PIECE].tolist(), values[i : i + self.PIECE].tolist()) for i in range(0, len(times), self.PIECE)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        t, v = own[self.ms].to_numpy(np.int64), own[self.value].to_numpy(float)
        held = list(self.held.get())
        times, values = (np.array([x for piece in held for x in piece[i]], dtype=d) for i, d in ((0, np.int64), (1, float)))
        by = np.argsort(times, kind="stable")
        times, values = times[by], values[by]
        sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
        # rows held that are no older than the window, and those of this batch up to each row
        old, new, place = np.searchsorted(times, t - self.window), np.searchsorted(t, t - self.window), np.arange(1, len(t) + 1)
        total = sums(values)[-1] - sums(values)[old] + sums(v)[place] - sums(v)[new]
        yield own[self.keep].assign(n=len(times) - old + place - new, total=total)
        # what a row after the watermark can still ask for stays
        gone = int(np.searchsorted(times, timerValues.getCurrentWatermarkInMs() - self.window))
        if gone and 2 * gone >= len(times):
            self.held.put(self._pieces(np.append(times[gone:], t), np.append(values[gone:], v)))
        else:
            self.held.appendList(self._pieces(t, v))
        newest = max(int(t[-1]), int(times[-1]) if held else int(t[-1]))
        if held:
            _end_at(self.handle, newest + self.window)
        else:  # a key without rows has no timer
            self.handle.registerTimer(newest + self.window)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def trailing_stream(sdf: DataFrame, key: str, ms: str, value: str, window_ms: int, tie: str | None = None, delay: str = DELAY) -> DataFrame:
    """(key, ms, tie, n, total): for each row the rows of its key no older than ``window_ms`` before it.

    A late row sees all rows that the window before it holds, and newer ones; rows without a time are dropped.
    Rows of one micro-batch are taken in order of time, then of ``tie``.  A key's state ends when the watermark has passed its newest row by the window.
    """
    keep = [key, ms, *([tie] if tie else [])]
    schema = T.StructType([*(sdf.schema[c] for c in keep), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    return _stateful(_timed(sdf, ms, delay), [key], _Trail(key, ms, value, window_ms, [ms] if tie is None else [ms, tie], keep), schema)


class _Switches(StatefulProcessor):
    """Counts the phases of a trace and how often its signature changes from one phase to the next."""

    def __init__(self, keys: list[str], order: str, signature: str, flags: list[str]):
        self.keys, self.order, self.signature, self.flags = keys, order, signature, flags

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = ", ".join(f"{f} long" for f in self.flags)
        self.trace = handle.getValueState("trace", f"signature string, phases long, switches long, {counts}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = self.trace.get()
        last, phases, switches, *counts = held if held else (None, 0, 0, *([0] * len(self.flags)))
        signs = own[self.signature].tolist()
        phases, switches = phases + len(signs), switches + sum(a != b for a, b in zip([last or signs[0], *signs], signs, strict=False))
        counts = [n + int(own[f].sum()) for n, f in zip(counts, self.flags, strict=True)]
        self.trace.update((signs[-1], phases, switches, *counts))
        yield pd.DataFrame([[*key, phases, switches, *counts]], columns=[*self.keys, "phases", "switches", *self.flags])

    def close(self) -> None:
        pass


def switch_stream(decided: DataFrame, keys: list[str], order: str, signature: Column, **flags: Column) -> DataFrame:
    """(keys, phases, switches, flags): for each trace so far its phases, the changes of ``signature`` from phase to phase, and the phases of each flag.

    Phases come in order from batch to batch and are put in order within one; the last signature is the state of a
    trace.  Write in update mode: a trace has a new row for each batch that adds to it.
    """
    held = decided.select(*keys, F.col(order).alias("phase_order"), signature.cast("string").alias("phase_signature"), *[v.cast("long").alias(k) for k, v in flags.items()])
    schema = T.StructType([*(decided.schema[k] for k in keys), *(T.StructField(n, T.LongType()) for n in ("phases", "switches", *flags))])
    return _stateful(held, keys, _Switches(keys, "phase_order", "phase_signature", list(flags)), schema, "Update", "None")


def window_stream(sdf: DataFrame, ts: str, keys: list[str], size: str, slide: str | None = None, delay: str = DELAY, **aggs: Column) -> DataFrame:
    """Tumbling or sliding windows by event time."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return sdf.withWatermark(ts, delay).groupBy(w, *keys).agg(*[v.alias(k) for k, v in aggs.items()])


def session_stream(sdf: DataFrame, ts: str, keys: list[str], gap: str, delay: str = DELAY) -> DataFrame:
    """(keys, event_start, event_end, rows): presence sessions; a pause longer than the gap ends one."""
    s = sdf.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("rows"))
    return s.select(*keys, F.col("s.start").alias("event_start"), F.col("s.end").alias("event_end"), "rows")


def probe_stream(sdf: DataFrame, keys: list[str], count: str) -> DataFrame:
    """(keys, aggregate_presence, co_presence, activity): probe levels kept up to date; write in update or complete mode."""
    agg = sdf.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(count).alias("_max"))
    return agg.select(*keys, F.when(F.col("_n") > 0, 3).otherwise(0).alias("aggregate_presence"), F.when(F.col("_max") >= 2, 3).otherwise(1).alias("co_presence"), F.when(F.col("_n") >= 168, 3).when(F.col("_n") >= 24, 2).otherwise(0).alias("activity"))


def publish_stream(sdf: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Writes all that is there and ends."""
    return sdf.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def table_stream(sdf: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the whole result of an aggregate at ``path``: each micro-batch writes it anew."""

    def one(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return sdf.writeStream.foreachBatch(one).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _epoch_sink(path: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch to its own partition; a batch that is tried again overwrites what it wrote before."""

    def one(batch: DataFrame, epoch: int) -> None:
        change(batch).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return one


def decide_stream(contexts: DataFrame, candidates: DataFrame, decide: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of context updates is decided against the static candidates and written to ``path``, once however often it is tried."""
    sink = _epoch_sink(path, lambda batch: decide(batch, candidates))
    return contexts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_stream(sdf: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows in update mode, by micro-batch; ``latest`` reads the last row of each key."""
    return sdf.writeStream.foreachBatch(_epoch_sink(path)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last micro-batch of each key."""
    rest = [c for c in df.columns if c not in keys and c != "epoch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(*keys, "x.*")
