"""Rows kept at a least distance in time from the last row kept, with the timeline of a key cut into slices.

Which row comes next after a kept one depends on that row's time alone, so a slice of a timeline is a table from the
time from which a row may be kept to the same time after the slice.  Rows are sorted in ranges of key and time; a key
that lies within one batch of rows is settled there.  The slices of longer keys follow "next row kept" by pointer
doubling to get their tables, tables are joined ``FAN`` at a time up to one for each key, and on the way back down every
slice learns where it starts, and all slices mark their rows side by side.

A table has an entry only for the times of one period after its slice begins, equal results merged: its size depends
on the period and the clock's resolution, not on the length of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import durable

FAN = 16
START = -(1 << 62)

Table = tuple[int, int, np.ndarray, np.ndarray]  # first and last time; times by which a row is taken, and the next start after each


def _doubled(step: np.ndarray) -> np.ndarray:
    """Where each position ends up that follows ``step`` to a position that is its own step."""
    while True:
        twice = step[step]
        if np.array_equal(twice, step):
            return step
        step = twice


def _marked(step: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions that ``step`` reaches from the starts, themselves included; the last position is the end."""
    on = np.zeros(len(step), dtype=bool)
    on[starts] = True
    while True:  # after k rounds, all within 2**k steps
        more = step[np.flatnonzero(on)]
        if on[more].all():
            break
        on[more] = True
        step = step[step]
    on[-1] = False
    return np.flatnonzero(on)


def _next(times: np.ndarray, period: int) -> np.ndarray:
    """For each position and the end, the position of the next row that may be kept after it."""
    return np.append(np.searchsorted(times, times + period), len(times))


def _merged(first: int, last: int, up: np.ndarray, out: np.ndarray, period: int) -> Table:
    """The table without entries that no start can meet, and with equal results as one entry."""
    n = int(np.searchsorted(up, first + period)) + 1
    up, out = up[:n], out[:n]
    ends = np.append(out[1:] != out[:-1], True)
    return first, last, up[ends], out[ends]


def slice_table(times: np.ndarray, period: int) -> Table:
    step = _next(times, period)
    step = np.where(step == len(times), np.arange(len(times) + 1), step)  # the last row kept stays
    return _merged(int(times[0]), int(times[-1]), times, times[_doubled(step)[:-1]] + period, period)


def follow(table: Table, starts: np.ndarray) -> np.ndarray:
    """The starts after a slice, of starts before it; those after its last row are not changed."""
    _, last, up, out = table
    at = np.minimum(np.searchsorted(up, starts), len(up) - 1)
    return np.where(starts > last, starts, out[at])


def joined(tables: list[Table], period: int) -> Table:
    """Consecutive slices as one."""

    def before(right: Table, left: Table) -> Table:
        first, last, up, out = left
        return _merged(first, right[1], np.concatenate([up, right[2]]), np.concatenate([follow(right, out), right[3]]), period)

    return reduce(before, reversed(tables[:-1]), tables[-1])


def _settled(times: np.ndarray, segment: np.ndarray, period: int) -> np.ndarray:
    """The rows kept of whole keys, side by side: ``segment`` numbers the keys from 0, in order."""
    low, width = int(times.min()), int(times.max()) - int(times.min()) + period + 1
    if width * (int(segment[-1]) + 1) >= 1 << 62:  # too wide for one line of numbers: halve the keys
        if segment[0] == segment[-1]:
            return _marked(_next(times, period), np.array([0]))
        cut = int(np.searchsorted(segment, (segment[0] + segment[-1]) // 2, side="right"))
        return np.concatenate([_settled(times[:cut], segment[:cut] - segment[0], period), cut + _settled(times[cut:], segment[cut:] - segment[cut], period)])
    line = segment * width + (times - low)
    step = _next(line, period)
    first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    own = np.append(segment, -1)
    step = np.where(own[step] == own, step, len(times))  # the end of a key
    return _marked(step, first)


def _cut(times: DataFrame, period: int) -> DataFrame:
    """(key, ms, tie) of the rows kept of keys within a batch, and (key, part, slice, times, ties) of slices of others."""
    kinds = dict(times.dtypes)
    schema = f"key {kinds['key']}, ms long, tie {kinds['tie']}, part int, slice int, times array<long>, ties array<{kinds['tie']}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(x for x in batches if x.num_rows):
            key, ms, tie = batch.columns
            code = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
            segment = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
            at, n = ms.to_numpy(), len(code)
            a, b = int(np.searchsorted(segment, 1)), int(np.searchsorted(segment, max(segment[-1], 1)))  # whole keys lie between
            kept = a + _settled(at[a:b], segment[a:b] - 1, period) if b > a else np.zeros(0, dtype=np.int64)
            if len(kept):
                held = [x.take(pa.array(kept)) for x in batch.columns]
                none = [pa.nulls(len(kept), t) for t in (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(tie.type))]
                yield pa.RecordBatch.from_arrays([*held, *none], ["key", "ms", "tie", "part", "slice", "times", "ties"])
            for side, (lo, hi) in enumerate(((0, a), (b, n)) if segment[-1] else ((0, n),)):
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x.slice(lo, hi - lo)) for x in (ms, tie)]
                empty = [key.slice(lo, 1), pa.nulls(1, pa.int64()), pa.nulls(1, tie.type)]
                yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), pa.array([2 * number + side], pa.int32()), *lists], ["key", "ms", "tie", "part", "slice", "times", "ties"])

    return times.mapInArrow(run, schema)


LEVEL = "key string, node long, first long, last long, up array<long>, out array<long>"


def _row(key: object, node: int, table: Table) -> dict:
    return {"key": key, "node": int(node), "first": table[0], "last": table[1], "up": table[2], "out": table[3]}


def _tables(pdf: pd.DataFrame) -> list[Table]:
    return [(r.first, r.last, np.asarray(r.up, dtype=np.int64), np.asarray(r.out, dtype=np.int64)) for r in pdf.itertuples()]


def _starts(slices: DataFrame, period: int, fan: int) -> DataFrame:
    """(node, start): the time from which a row may be kept, for each slice."""

    def tables(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame([_row(r.key, r.node, slice_table(np.asarray(r.times, dtype=np.int64), period)) for r in pdf.itertuples()], columns=["key", "node", "first", "last", "up", "out"])

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return pd.DataFrame([_row(pdf["key"].iloc[0], pdf["node"].iloc[0] // fan, joined(_tables(pdf), period))])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        starts, now = [], np.array([pdf["start"].iloc[0]])
        for table in _tables(pdf):
            starts.append(int(now[0]))
            now = follow(table, now)
        return pdf[["key", "node"]].assign(start=starts)

    levels = [durable(slices.select("key", "node", "times").mapInPandas(tables, LEVEL))]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top >= fan:
        levels.append(durable(levels[-1].groupBy("key", F.expr(f"node div {fan}")).applyInPandas(up, LEVEL)))
        top //= fan
    starts = levels[-1].select("key").distinct().select("key", F.lit(0).cast("long").alias("above"), F.lit(START).alias("start"))
    for level in reversed(levels):
        held = level.withColumn("above", F.expr(f"node div {fan}")).join(starts.hint("merge"), ["key", "above"])
        starts = held.groupBy("key", "above").applyInPandas(down, "key string, node long, start long").withColumnRenamed("node", "above")
    return starts.select("key", F.col("above").alias("node"), "start")


def rate_limit(df: DataFrame, key: str, ms: str, period_ms: int, tie: str, fan: int = FAN) -> DataFrame:
    """Rows at least ``period_ms`` after the last row kept of their key, in order of time and tie; rows without a time pass.

    A null key is a key of its own.  Rows of one key, time and tie are kept or dropped together.
    """
    if period_ms <= 0:
        return df
    timed = df.where(F.col(ms).isNotNull())
    times = timed.groupBy(F.col(key).alias("key"), F.col(ms).cast("long").alias("ms")).agg(F.min(tie).alias("tie"))
    cut = durable(_cut(times.repartitionByRange("key", "ms").sortWithinPartitions("key", "ms"), period_ms))
    slices = cut.where("part is not null")
    width, most = 1, slices.agg(F.max("slice")).first()[0] or 0
    while width <= most:
        width *= fan
    named = F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit(""))
    slices = slices.select(F.col("key").alias("own"), named.alias("key"), (F.col("part").cast("long") * width + F.col("slice")).alias("node"), "times", "ties")
    placed = slices.join(_starts(slices, period_ms, fan).hint("merge"), ["key", "node"]).select("own", "times", "ties", "start")
    kind = dict(times.dtypes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, ties = (batch.column(k).slice(i, 1).flatten() for k in (1, 2))
                own = at.to_numpy()
                kept = pa.array(_marked(_next(own, period_ms), np.searchsorted(own, [batch.column(3)[i].as_py()])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(kept), dtype=np.int64))), at.take(kept), ties.take(kept)], ["key", "ms", "tie"])

    marked = placed.mapInArrow(mark, f"key {kind['key']}, ms long, tie {kind['tie']}")
    kept = cut.where("part is null").select("key", "ms", "tie").unionByName(marked).hint("merge")
    same = timed[key].eqNullSafe(kept["key"]) & (timed[ms].cast("long") == kept["ms"]) & timed[tie].eqNullSafe(kept["tie"])
    return timed.join(kept, same, "left_semi").unionByName(df.where(F.col(ms).isNull()))
