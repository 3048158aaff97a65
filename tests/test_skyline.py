"""Pareto fronts against all pairs, for small and very large requests."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quietgrid.operators import skyline

SCHEMA = "r string, i long, a long, b double, c int, node int, part int"


def beats(x, y):
    return all(p <= q for p, q in zip(x, y, strict=True)) and x != y


def test_fronts_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for r in ["x", "y", None, *(f"r{i}" for i in range(40))]:
        n = 700 if r in ("x", None) else rng.randint(1, 90)
        for _ in range(n):
            a = rng.randint(-50, 50)
            rows.append((r, len(rows), a, float(-a + rng.randint(0, 3)), rng.randint(0, 3), 1, 2))  # long fronts
    rows += [("x", 10_000, None, 1.0, 1, 1, 2), ("z", 10_001, 1, 1.0, 1, 1, 2), ("z", 10_002, 1, 1.0, 1, 1, 2)]
    want = {i for r, i, a, b, c, *_ in rows if a is not None and not any(o[0] == r and o[2] is not None and beats(o[2:5], (a, b, c)) for o in rows)}
    df = spark.createDataFrame(rows, SCHEMA).drop("node").withColumn("block", F.lit(1)).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for fan, block in ((16, 4096), (2, 5)):  # merged to the end, and by pairs of blocks
            got = skyline.pareto_front(df, "r", ["a", "b", "c"], fan, block)
            assert got.columns == df.columns and {x.i for x in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert skyline.pareto_front(df.limit(0), "r", ["a", "b", "c"]).count() == 0


def test_front_of_a_block():
    rng = np.random.default_rng(1)
    for _ in range(30):
        v = np.unique(rng.integers(0, 12, (int(rng.integers(1, 400)), 3)).astype(float), axis=0)
        v = v[rng.permutation(len(v))]
        want = [i for i in range(len(v)) if not any((v[j] <= v[i]).all() and (v[j] != v[i]).any() for j in range(len(v)))]
        assert skyline.front(v).tolist() == want


def test_a_million_vectors_of_one_request(spark):
    n = 1_000_000
    at = F.pmod(F.xxhash64("id"), F.lit(100_003))
    df = spark.range(n, numPartitions=8).select(F.lit("hot").alias("r"), F.col("id").alias("a"), (F.lit(n) - F.col("id") + at).alias("b"))
    got = skyline.pareto_front(df, "r", ["a", "b"]).select("a", "b").toPandas().sort_values("a")
    all_rows = df.select("a", "b").toPandas().sort_values(["a", "b"])
    low = np.minimum.accumulate(all_rows["b"].to_numpy())
    first = np.append(True, all_rows["b"].to_numpy()[1:] < low[:-1])
    assert got["a"].tolist() == all_rows["a"][first].tolist()


def test_requests_of_few_rows_are_joined_not_sorted_by_range(spark, capsys):
    """no pass through Python and no table written between, in as many partitions as the rows ask for."""
    df = spark.range(6000).select((F.col("id") % 2000).alias("r"), (F.col("id") * 7 % 5).alias("a"), (F.col("id") * 11 % 3).alias("b"))
    out = skyline.pareto_front(df, "r", ["a", "b"])
    out.explain()
    plan = capsys.readouterr().out
    assert "LeftAnti" in plan and "Arrow" not in plan and "FileScan" not in plan
    rows = [tuple(x) for x in df.collect()]
    by = {}
    for r, *v in rows:
        by.setdefault(r, []).append(tuple(v))
    assert sorted(map(tuple, out.collect())) == sorted((r, *v) for r, *v in rows if not any(beats(o, tuple(v)) for o in by[r]))


def test_nan_is_the_greatest_in_requests_of_any_size(spark):
    """as in the SQL, in which NaN is above all numbers and equal to itself."""
    nan, inf = float("nan"), float("inf")
    few = [("few", nan, 1.0), ("few", inf, 1.0), ("nan", nan, nan)]
    many = [("many", nan, 1.0), ("many", inf, 1.0)] + [("many", inf, 2.0 + i) for i in range(100)]
    got = skyline.pareto_front(spark.createDataFrame(few + many, "r string, a double, b double"), "r", ["a", "b"]).collect()
    assert sorted((x.r, str(x.a), str(x.b)) for x in got) == [("few", "inf", "1.0"), ("many", "inf", "1.0"), ("nan", "nan", "nan")]
