"""Interval joins and runs of overlapping intervals against all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quietgrid.operators import frames, intervals


def some(rng, n, far=400, keys=("a", "b", None)):
    out = []
    for _ in range(n):
        start = rng.randint(-far, far)
        out.append((rng.choice(keys), start, start + rng.choice([0, 1, 3, 10, 60, rng.randint(0, 300), -1 if rng.random() < 0.1 else 5])))
    return out


def test_widest_overlap_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, *r, 1, 2) for i, r in enumerate(some(rng, 300))] + [(1000, "c", 1, 5, 1, 2), (1001, "a", None, 3, 1, 2)]
    others = some(rng, 200)
    left = spark.createDataFrame(rows, "id long, k string, start long, end long, level int, cell int").drop("level", "cell")
    right = spark.createDataFrame(others, "k string, start long, end long")
    got = {r.id: r.overlap for r in intervals.widest_overlap(left, right, "k", ["id"]).collect()}
    for i, k, a, b, *_ in rows:
        best = max([min(b, y) - max(a, x) + 1 for o, x, y in others if o == k and x <= y and a is not None and a <= b], default=0)
        assert got[i] == max(0, best), i
    assert all(v == 0 for v in (r.overlap for r in intervals.widest_overlap(left, right.limit(0), "k", ["id"]).collect()))


def test_runs_hang_together(spark):
    rng = random.Random(3)
    rows = [(i, k, a, max(a, b)) for i, (k, a, b) in enumerate(some(rng, 200, 3000) + [("one", 5, 9)] * 3 + [("wide", x, x) for x in range(0, 10_000_000, 999_983)])]
    got = {r.id: (r.k, r.run) for r in intervals.overlap_runs(spark.createDataFrame(rows, "id long, k string, a long, b long").repartition(3), "k", "a", "b").collect()}
    by = defaultdict(list)
    for i, k, a, b in rows:
        by[k].append((a, b, i))
    for k, own in by.items():
        reach = begun = None
        for a, b, i in sorted(own):
            if reach is None or a > reach:
                begun, reach = a, b
            reach = max(reach, b)
            assert got[i] == (k, begun), i


def matched(true, pred, tolerance):
    order = lambda rows: sorted((a, b) for a, b in rows)
    free, hits = [True] * len(true), 0
    true = order(true)
    for a, b in order(pred):
        best, at = 0, None
        for i, (x, y) in enumerate(true):
            n = min(b, y + tolerance) - max(a, x - tolerance) + 1
            if free[i] and n > best:
                best, at = n, i
        if at is not None:
            free[at], hits = False, hits + 1
    return hits


def test_matches_equal_a_plain_pass(spark):
    for seed, tolerance in ((1, 0), (2, 4), (3, 0)):
        rng = random.Random(seed)
        true, pred = ([(k, a, b) for k, a, b in some(rng, 150, 700, ("x", "y", "z", None)) if a <= b] for _ in range(2))
        table = lambda rows: spark.createDataFrame(rows, "sample string, event_start long, event_end long").repartition(3)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs that go on in the next batch
        try:
            got = {r.sample: (r.tp, r.fp, r.fn) for r in frames.match_events(table(true), table(pred), tolerance).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for k in {r[0] for r in true + pred}:
            t, p = ([r[1:] for r in rows if r[0] == k] for rows in (true, pred))
            tp = matched(t, p, tolerance)
            assert got[k] == (tp, len(p) - tp, len(t) - tp), (seed, k)


def test_a_hot_sample_is_many_tasks(spark):
    """Two hundred thousand events of one sample: runs are dealt to parts, and so are the cells of a join."""
    n = 200_000
    true = spark.range(n, numPartitions=4).select(F.lit("s").alias("sample"), (F.col("id") * 10).alias("event_start"), (F.col("id") * 10 + 5).alias("event_end"))
    r = frames.match_events(true, true, 0).first()
    assert (r.tp, r.fp, r.fn) == (n, 0, 0)
    runs = intervals.overlap_runs(true.withColumn("a", F.col("event_start")).withColumn("b", F.col("event_end")), "sample", "a", "b")
    dealt = runs.repartition(4, "sample", "run").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) == 4 and max(x["count"] for x in dealt) < n / 3
    assert Counter(r.overlap for r in intervals.widest_overlap(true.selectExpr("sample", "event_start AS start", "event_end AS end"), true.selectExpr("sample", "event_start AS start", "event_end AS end"), "sample", ["sample", "start"]).groupBy("overlap").count().select("overlap").collect()) == {6: 1}


def test_tuning_keeps_error_rows_and_the_first_best(spark):
    pred = spark.createDataFrame([("s", f, v) for f, v in enumerate([0.9, 0.1, 0.9, 0.4, 0.0, 0.9, 0.9, None])], "sample string, frame long, score double")
    labels = spark.createDataFrame([("s", f, int(f in (0, 1, 2, 6))) for f in range(7)], "sample string, frame long, present int")
    rows = frames.tune_postprocess(pred, labels, [0.5, None], [0, 1], [1], [0, 2, -1], 1, 0, "f1").orderBy("config").collect()
    assert [r.config for r in rows] == list(range(12)) and [r.best for r in rows].count(True) == 1
    assert all((r.error is not None) == (r.confidence is None) and (r.f1 is None) == (r.error is not None) for r in rows)
    by = {(r.dilation, r.gap): r for r in rows if r.error is None}
    assert (by[0, 0].tp, by[0, 0].fp, by[0, 0].fn) == (3, 1, 1) and (by[0, 2].tp, by[0, 2].fp, by[0, 2].fn) == (4, 1, 0)
    assert by[0, 2].best is (by[0, 2].f1 == max(r.f1 for r in by.values()))
    assert (by[0, 0].event_precision, by[0, 0].event_recall) == (2 / 3, 1.0) and by[0, -1].tp == by[0, 0].tp
    far = labels.withColumn("frame", F.col("frame") + 100)
    assert all("no matching rows" in r.error and not r.best for r in frames.tune_postprocess(pred, far, [0.5], [0], [1], [0]).collect())


def test_cells_are_dealt_by_their_rows(spark, monkeypatch, capsys):
    """a task's cells do not grow with the table, and null keys meet as others do."""
    monkeypatch.setattr(intervals.dealt, "__kwdefaults__", {"rows": 100, "count": None})
    left = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 19).alias("end")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    right = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") * 6).alias("start"), (F.col("id") * 6 + F.col("id") % 9).alias("end")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    out = intervals.widest_overlap(left, right, "k", ["id"])
    out.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    marks = [tuple(r) for r in right.collect()]
    want = {i: max([0, *(min(e, y) - max(s, x) + 1 for kk, x, y in marks if kk == k)]) for k, i, s, e in map(tuple, left.collect())}
    assert {r.id: r.overlap for r in out.collect()} == want


def test_runs_with_one_event_of_a_side_are_not_walked(monkeypatch):
    """hits of all runs at once are those of the greedy pass, which only runs with several events of both sides need."""
    rng, rows, starts = random.Random(5), [], [0]
    for run in range(400):
        at = run * 1000
        for _ in range(rng.randint(1, 6)):  # each begins where one before still reaches
            at += rng.randint(0, 5)
            rows.append((at, at + rng.randint(5, 12), rng.random() < 0.5))
        starts.append(len(rows))
    a, b, true = (np.array(x) for x in zip(*rows, strict=True))
    walk, walked = intervals._greedy, []
    want = [walk(a[x:y], b[x:y], true[x:y]) for x, y in zip(starts[:-1], starts[1:], strict=True)]
    monkeypatch.setattr(intervals, "_greedy", lambda *run: walked.append(1) or walk(*run))
    assert intervals._hits_of_runs(a, b, true, np.array(starts)).tolist() == want
    several = [x for x, y in zip(starts[:-1], starts[1:], strict=True) if min(true[x:y].sum(), (~true[x:y]).sum()) > 1]
    assert len(walked) == len(several) < 300
