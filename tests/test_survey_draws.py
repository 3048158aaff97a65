"""Bootstrap draws by splitting, and assignments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quietgrid.operators import survey


def test_draws_split_like_a_multinomial(spark):
    k, levels, iterations = 1003, 4, 400
    rows = survey.split_draws(spark, iterations, k, levels, 5).toPandas()
    table = rows.pivot_table(index="it", columns="bucket", values="draws", fill_value=0)
    assert (table.sum(axis=1) == k).all() and table.shape == (iterations, 16)
    p = np.diff([-(-b * k // 16) for b in range(17)]) / k
    assert np.abs(table.mean().to_numpy() - k * p).max() < 4 * np.sqrt(k * p * (1 - p) / iterations).max()
    assert np.abs(table.var().to_numpy() / (k * p * (1 - p)) - 1).max() < 0.35


def test_bootstrap_of_many_clusters(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("c"), F.pmod(F.xxhash64("id"), F.lit(5)).cast("double").alias("v"))
    one, many = (survey.cluster_bootstrap(df, "c", "v", 200, 3, per).first() for per in (1 << 30, 100))
    assert one.mean == many.mean and abs(one.low - many.low) < 0.01 and abs(one.high - many.high) < 0.01 and one.low < one.mean < one.high


def test_no_text_twice_though_it_lies_in_two_blocks(spark):
    # "x" stands in blocks a, b and c; each session gets one of it at the most
    items = [(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "a", "y"), (5, "b", "z"), (6, "c", "w"), (7, "a", "y"), (8, "b", None), (9, "b", None)]
    table = spark.createDataFrame(items, "item int, block string, shown string")
    counts = spark.createDataFrame([(1, 9), (4, 2)], "item int, used long")
    sessions = spark.range(40).withColumnRenamed("id", "session")
    text = {i: t or f"own {i}" for i, _, t in items}
    block = {i: b for i, b, _ in items}
    by = {}
    for r in survey.assign_items(table, counts, sessions, 3, 1, "shown").collect():
        by.setdefault(r.session, []).append(r.item)
    assert len(by) == 40 and all(len(v) == 3 and len({text[i] for i in v}) == 3 and len({block[i] for i in v}) == 3 for v in by.values())
    assert {4, 7} <= {i for v in by.values() for i in v}  # items of one text take turns
    # more than there are texts: all of them, once each
    by = {}
    for r in survey.assign_items(table, counts, sessions, 20, 0, "shown").collect():
        by.setdefault(r.session, []).append(r.item)
    assert all(sorted(text[i] for i in v) == sorted(set(text.values())) for v in by.values())


def test_sequential_assignment(spark):
    items = spark.createDataFrame([(i, i % 3) for i in range(7)], "item int, g int")
    sessions = spark.range(30).withColumnRenamed("id", "session")
    order = [0, 3, 6, 1, 4, 2, 5]
    by = {}
    for r in survey.assign_sequential(items, sessions, 4, ["g"]).orderBy("session", "place").collect():
        by.setdefault(r.session, []).append(r.item)
    assert len(by) == 30 and all(v == [order[(order.index(v[0]) + j) % 7] for j in range(4)] for v in by.values()) and len({v[0] for v in by.values()}) > 3
    assert survey.assign_sequential(items, sessions, 99, ["g"]).groupBy("session").count().where("count <> 7").count() == 0
    assert survey.assign_sequential(items.limit(0), sessions, 4, ["g"]).count() == 0
