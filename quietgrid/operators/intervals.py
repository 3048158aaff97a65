"""Joins of intervals by overlap, and intervals cut into runs that overlap, without one task a sample.

Bounds are whole numbers and both belong to the interval.  An interval of length n has the level log2(n), rounded up,
and lies in at most two cells of that width.  It stands in its cells at its own level and at every higher level that
occurs, so two intervals that overlap share a cell at the higher of their levels: an equi-join finds them, however long
or short they are and however many a sample has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import dealt

BUCKETS = 1024


def _level(start: Column, end: Column) -> Column:
    return F.ceil(F.log2(F.greatest(end - start + 1, F.lit(1)).cast("double"))).cast("int")


def cells(df: DataFrame, start: Column, end: Column, levels: list[int]) -> DataFrame:
    """The rows with ``level``, ``cell`` and ``own`` (it is the row's own level), once for each cell they stand in."""
    own = _level(start, end)
    wide = F.array(*map(F.lit, levels))
    of = lambda x, lv: F.floor(x / F.call_function("shiftleft", F.lit(1).cast("long"), lv)).cast("long")
    each = F.transform(F.filter(wide, lambda lv: lv >= own), lambda lv: F.transform(F.sequence(of(start, lv), of(end, lv)), lambda c: F.struct(lv.alias("level"), c.alias("cell"), (lv == own).alias("own"))))
    return df.select("*", F.inline(F.flatten(each)))


def levels_of(*sides: tuple[DataFrame, Column, Column]) -> list[dict[int, int]]:
    """The intervals of each side by level, 64 levels at most."""
    found = reduce(DataFrame.union, [df.select(F.lit(i).alias("side"), _level(a, b).alias("level")) for i, (df, a, b) in enumerate(sides)]).groupBy("side", "level").count().collect()
    return [{r.level: r["count"] for r in found if r.side == i and r.level is not None} for i in range(len(sides))]


def _most_cells(sizes: dict[int, int], levels: list[int]) -> int:
    """No fewer than the cells that intervals stand in."""
    return sum(2 * n * sum(lv >= own for lv in levels) for own, n in sizes.items())


def widest_overlap(rows: DataFrame, others: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(keys, overlap) of ``rows`` (keys, key, start, end): the most places that one of ``others`` (key, start, end) shares with each.

    A row that none overlaps has 0.  A pair that meets in two cells counts once, as the most of two equals is one.
    Cells and rows are dealt to as many partitions as they ask for.
    """
    a, b = F.col("start"), F.col("end")
    others = others.select(key, "start", "end").where(a <= b)
    mine, theirs = levels_of((rows.where(a <= b), a, b), (others, a, b))
    every = sorted({*mine, *theirs})  # a pair meets at the higher of its levels, so below the other side's least none do
    wide, narrow = [lv for lv in every if lv >= min(theirs, default=0)] or every, [lv for lv in every if lv >= min(mine, default=0)]
    most = max(_most_cells(mine, wide), _most_cells(theirs, narrow))
    at = F.struct(F.col(key), "level", "cell")  # equal where the key is null, too
    left = dealt(cells(rows.where(a <= b), a, b, wide).select(*dict.fromkeys([*keys, "start", "end"]), at.alias("at"), "own"), "at", count=most)
    right = dealt(cells(others, a, b, narrow).select(at.alias("_at"), F.col("start").alias("_a"), F.col("end").alias("_b"), F.col("own").alias("_own")), "_at", count=most)
    same = (F.col("at") == F.col("_at")) & (F.col("own") | F.col("_own"))
    size = F.when(F.col("_a").isNotNull(), F.least(b, F.col("_b")) - F.greatest(a, F.col("_a")) + 1)
    pairs = left.join(right.hint("merge"), same, "left").select("at", *keys, F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).cast("long").alias("overlap"))
    by_cell = pairs.groupBy("at", *keys).agg(F.max("overlap").alias("overlap")).drop("at")  # where the pairs are
    empty = rows.where(~F.coalesce(a <= b, F.lit(False))).select(*keys, F.lit(0).cast("long").alias("overlap"))
    return dealt(by_cell.unionByName(empty), *keys, count=most).groupBy(*keys).agg(F.max("overlap").alias("overlap"))


def overlap_runs(df: DataFrame, key: str, start: str, end: str, name: str = "run") -> DataFrame:
    """Rows with ``name``: the start of their run, the intervals of a key that hang together by overlaps.

    A key's span is cut into ``BUCKETS`` buckets by start; a run begins where no interval before reaches, which
    running maxima inside a bucket and over the buckets before (``BUCKETS`` rows of a key) tell.
    """
    span = df.groupBy(key).agg(F.min(start).alias("_low"), F.max(start).alias("_high"))
    named = span.select(F.col(key).alias("_key"), "_low", "_high")
    placed = df.join(named.hint("merge"), df[key].eqNullSafe(F.col("_key")))
    width = F.floor((F.col("_high") - F.col("_low")) / BUCKETS) + 1
    placed = placed.withColumn("_bucket", F.floor((F.col(start) - F.col("_low")) / width).cast("int")).drop("_key", "_low", "_high")
    inside = Window.partitionBy(key, "_bucket").orderBy(start)

    def carried(rows: DataFrame, value: Column, out: str, frame: tuple[int, int]) -> DataFrame:
        """Adds ``out``: the greatest value of the rows before, or up to the row itself, in the whole key."""
        tops = rows.groupBy(key, "_bucket").agg(F.max(value).alias("_top"))
        before = F.max("_top").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        tops = tops.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), before.alias("_before"))
        held = rows.withColumn("_own", F.max(value).over(inside.rowsBetween(*frame)))
        held = held.join(tops.hint("merge"), held[key].eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")))
        return held.withColumn(out, F.greatest("_own", "_before")).drop("_own", "_before", "_k", "_b")

    reached = carried(placed, F.col(end), "_reached", (Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col(start) > F.col("_reached"), F.lit(True)), F.col(start))
    # equal starts are one run: those after the first overlap it, so the greatest beginning up to a row is its own run's
    return carried(reached, begins, name, (Window.unboundedPreceding, 0)).drop("_reached", "_bucket")


def _greedy(a: np.ndarray, b: np.ndarray, true: np.ndarray) -> int:
    """How many predictions of a run, in order, find an unmatched true event; the largest overlap first, then the first."""
    t, p = np.flatnonzero(true), np.flatnonzero(~true)
    if not len(t) or not len(p):
        return 0
    ta, tb = a[t], b[t]
    free, hits = np.ones(len(t), dtype=bool), 0
    reach = np.maximum.accumulate(tb)
    for k in p:
        lo, hi = np.searchsorted(reach, a[k]), np.searchsorted(ta, b[k], side="right")
        if lo < hi:
            size = np.where(free[lo:hi], np.minimum(tb[lo:hi], b[k]) - np.maximum(ta[lo:hi], a[k]) + 1, 0)
            best = int(size.argmax())
            if size[best] > 0:
                free[lo + best] = False
                hits += 1
    return hits


def _hits_of_runs(a: np.ndarray, b: np.ndarray, true: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``_greedy`` of consecutive runs.

    The intervals of a run hang together by overlaps, so the only prediction of one overlaps a true event of it, and the
    only true event a prediction: such a run has a hit, and one without either side none.  Only the others are walked.
    """
    nt = np.add.reduceat(true.astype(np.int64), starts[:-1])
    hits = np.minimum(nt, np.diff(starts) - nt)
    whole = np.minimum.reduceat(b - a, starts[:-1]) >= 0
    for k in np.flatnonzero((hits > 1) | ~whole):
        own = slice(starts[k], starts[k + 1])
        hits[k] = _greedy(a[own], b[own], true[own])
    return hits


def greedy_hits(events: DataFrame, key: str) -> DataFrame:
    """(key, hits) of each run of events (key, run, a, b, true): predictions matched to true events by ``_greedy``.

    The rows of a run come one after the other in a sorted part; only the run at hand is held.
    """
    kind = dict(events.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def counted(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            a, b, true = table["a"].to_numpy(), table["b"].to_numpy(), table["true"].to_numpy(zero_copy_only=False)
            hits = _hits_of_runs(a, b, true, starts)
            own = table[key].combine_chunks().take(pa.array(starts[:-1]))
            return pa.RecordBatch.from_arrays([own, pa.array(hits, pa.int64())], [key, "hits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            code = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            run_of = table["run"].to_numpy()
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (run_of[1:] != run_of[:-1])))
            if len(first) > 1:  # the last run may go on in the next batch
                yield counted(table.slice(0, first[-1]), first)
                held = table.slice(first[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield counted(table, np.array([0, len(table)]))

    rows = events.select(key, "run", "a", "b", "true").repartition(key, "run").sortWithinPartitions(key, "run", "a", "b")
    return rows.mapInArrow(run, f"{key} {kind}, hits long")
