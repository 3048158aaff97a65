"""Rate limits over slices of a timeline against a walk from row to row."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietgrid.operators import pacing

SCHEMA = "k string, ms long, i long, part int, start long, key int"


def walked(rows, period):
    last, kept = {}, []
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        if r[0] not in last or r[1] - last[r[0]] >= period:
            last[r[0]] = r[1]
            kept.append(r)
    return kept + [r for r in rows if r[1] is None]


def rows_of(rng):
    rows = [(f"k{rng.randint(0, 40)}", rng.randint(-500, 3000)) for _ in range(1500)]
    rows += [("hot", rng.randint(0, 20_000)) for _ in range(3000)] + [(None, t) for t in range(0, 900, 7)]
    rows += [("k1", None), (None, None), ("same", 5), ("same", 5), ("far", -(1 << 60)), ("far", 1 << 60)]
    return [(k, t, i, 1, 2, 3) for i, (k, t) in enumerate(rows)]


@pytest.mark.parametrize("period", [1, 50, 4000])
def test_rate_limit_equals_a_walk(spark, period):
    rows = rows_of(random.Random(period))
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # slices of 64 rows
    try:
        got = pacing.rate_limit(df, "k", "ms", period, "i", fan=3)
        assert got.columns == df.columns
        assert Counter(map(tuple, got.collect())) == Counter(walked(rows, period))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rate_limit_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pacing.rate_limit(df, "k", "ms", 10, "i").count() == 0
    some = spark.createDataFrame([("a", 1, 1, 1, 1, 1)] * 3, SCHEMA)
    assert pacing.rate_limit(some, "k", "ms", 0, "i").count() == 3


def test_a_hot_key_is_many_slices(spark):
    """A million rows of one key: slices of at most a batch, in several parts of the sort."""
    df = spark.range(1_000_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("ms"), F.col("id").alias("i"))
    times = df.select(F.col("k").alias("key"), "ms", F.col("i").alias("tie")).repartitionByRange(4, "key", "ms").sortWithinPartitions("key", "ms")
    slices = pacing._cut(times, 1000).select("part", F.size("times").alias("n")).collect()
    assert len({r.part for r in slices}) == 4 and max(r.n for r in slices) <= 10_000 and sum(r.n for r in slices) == 1_000_000
    kept = pacing.rate_limit(df, "k", "ms", 1000, "i")
    assert [r.ms for r in kept.orderBy("ms").limit(3).collect()] == [0, 1002, 2004] and kept.count() == -(-3_000_000 // 1002)


def test_tables_join_like_one_slice():
    rng = np.random.default_rng(7)
    for _ in range(200):
        times = np.unique(rng.integers(0, 400, rng.integers(2, 60)))
        period = int(rng.integers(1, 80))
        cuts = np.unique(rng.integers(1, len(times) + 1, 4))
        parts = [x for x in np.split(times, cuts) if len(x)]
        whole, own = pacing.slice_table(times, period), pacing.joined([pacing.slice_table(x, period) for x in parts], period)
        starts = np.append(np.arange(pacing.START, pacing.START + 1), np.arange(-3, int(times[0]) + period + 1))
        assert np.array_equal(pacing.follow(whole, starts), pacing.follow(own, starts))
