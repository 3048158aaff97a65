"""Streams over parquet files give what the batch forms give."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quietgrid.operators import observe, pacing
from quietgrid.streaming import streams


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def drained(spark, sdf, name, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


ROWS = [("a", 1000, 1.0), ("a", 1200, 2.0), ("a", 1600, 3.0), ("b", 50, 4.0)]


def test_rate_limit_and_trailing(spark, tmp_path):
    sdf = source(spark, tmp_path, ROWS, "k string, ms long, v double")
    got = sorted((r.k, r.ms) for r in drained(spark, streams.rate_limit_stream(sdf, "k", "ms", 500), "limited").collect())
    batch = pacing.rate_limit(spark.read.parquet(str(tmp_path / "in")), "k", "ms", 500, "v")
    assert got == sorted((r.k, r.ms) for r in batch.collect()) == [("a", 1000), ("a", 1600), ("b", 50)]
    trail = drained(spark, streams.trailing_stream(sdf, "k", "ms", "v", 400), "trailed")
    assert sorted((r.k, r.ms, r.n, r.total) for r in trail.collect()) == [("a", 1000, 1, 1.0), ("a", 1200, 2, 3.0), ("a", 1600, 2, 5.0), ("b", 50, 1, 4.0)]


def in_turn(spark, tmp_path, batches, schema):
    """A stream that reads one file of rows in each micro-batch, in order."""
    folder = tmp_path / "turns"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("part-*.parquet"):
            if not f.name.startswith("part-turn"):
                os.utime(f, (1_000_000 + i, 1_000_000 + i))
                f.rename(folder / f"part-turn{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_and_state_that_ends(spark, tmp_path):
    minute = 60_000
    batches = [[("a", 100 * minute, 1.0), ("b", 100 * minute, 1.0)], [("a", 95 * minute, 2.0), ("a", 104 * minute, 4.0)], [("a", 300 * minute, 8.0)], [("a", 94 * minute, 16.0), ("b", 301 * minute, 32.0)]]
    sdf = in_turn(spark, tmp_path, batches, "k string, ms long, v double")
    got = drained(spark, streams.trailing_stream(sdf, "k", "ms", "v", 10 * minute), "late_trail")
    rows = {(r.k, r.ms // minute): (r.n, r.total) for r in got.collect()}
    # the row of 95 is late but within the watermark and sees the newer one; that of 94 comes after the watermark and is dropped
    assert rows == {("a", 100): (1, 1.0), ("b", 100): (1, 1.0), ("a", 95): (2, 3.0), ("a", 104): (3, 7.0), ("a", 300): (1, 8.0), ("b", 301): (1, 32.0)}
    kept = drained(spark, streams.rate_limit_stream(sdf, "k", "ms", 20 * minute), "late_limit")
    assert {(r.k, r.ms // minute) for r in kept.collect()} == {("a", 100), ("b", 100), ("a", 300), ("b", 301)}


def test_state_is_cleared_by_the_watermark(spark, tmp_path):
    minute = 60_000
    batches = [[(f"k{i}", minute, 1.0) for i in range(20)], [("k0", 500 * minute, 1.0)], [("k0", 501 * minute, 1.0)]]
    sdf = in_turn(spark, tmp_path, batches, "k string, ms long, v double")
    for name, out in (("ended_limit", streams.rate_limit_stream(sdf, "k", "ms", minute)), ("ended_trail", streams.trailing_stream(sdf, "k", "ms", "v", minute))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        held = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
        assert max(m["numDeletedTimers"] for m in held) >= 19  # the timers of all keys but one end in one batch


def test_switches_and_a_batch_tried_again(spark, tmp_path):
    batches = [[("t", 1, "a"), ("t", 2, "b"), ("u", 1, "x")], [("t", 4, "b"), ("t", 3, "a")], [("u", 2, "x"), ("u", 3, None)]]
    sdf = in_turn(spark, tmp_path, batches, "trace string, phase int, choice string")
    sign = F.coalesce("choice", F.lit("none"))
    out = streams.switch_stream(sdf, ["trace"], "phase", sign, missing=F.col("choice").isNull())
    path = str(tmp_path / "switched")
    streams.update_stream(out, path, str(tmp_path / "cp")).awaitTermination(120)
    read = lambda: {r.trace: (r.phases, r.switches, r.missing) for r in streams.latest(spark.read.parquet(path), ["trace"]).collect()}
    assert read() == {"t": (4, 3, 0), "u": (3, 1, 1)}
    # an epoch that is written again replaces what it wrote
    rows = spark.read.parquet(path).count()
    last = spark.read.parquet(path).where("epoch = 1").drop("epoch").collect()
    again = spark.createDataFrame(last, "trace string, phases long, switches long, missing long")
    for _ in range(2):
        streams._epoch_sink(path)(again, 1)
    assert spark.read.parquet(path).count() == rows and read() == {"t": (4, 3, 0), "u": (3, 1, 1)}


def test_windows_sessions_probes(spark, tmp_path):
    rows = [("a", 60 * i, i % 3) for i in (0, 1, 2, 30, 31, 100)]
    sdf = source(spark, tmp_path, rows, "k string, s long, n int").withColumn("ts", F.timestamp_seconds("s"))
    w = drained(spark, streams.window_stream(sdf, "ts", ["k"], "10 minutes", n=F.count("*")), "windowed", "complete")
    assert sorted(r.n for r in w.collect()) == [1, 2, 3]
    s = drained(spark, streams.session_stream(sdf, "ts", ["k"], "5 minutes"), "sessions", "complete")
    assert sorted(r["rows"] for r in s.collect()) == [1, 2, 3]
    p = drained(spark, streams.probe_stream(sdf, ["k"], "n"), "probed", "complete").first()
    assert (p.aggregate_presence, p.co_presence, p.activity) == (3, 3, 0)


def test_row_wise_operators_publish_and_decide(spark, tmp_path):
    sdf = source(spark, tmp_path, ROWS, "k string, ms long, v double")
    gated = observe.trigger_gate(sdf.withColumn("readings", F.create_map(F.lit("v"), F.col("v"))), "v >= 2")
    streams.publish_stream(gated.drop("readings"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    candidates = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("b", 3, 1)], "k string, c int, risk int")
    best = lambda b, c: b.select("k").distinct().join(c, "k").groupBy("k").agg(F.min_by("c", "risk").alias("c"))
    streams.decide_stream(sdf, candidates, best, str(tmp_path / "dec"), str(tmp_path / "cp2")).awaitTermination(120)
    assert {(r.k, r.c) for r in spark.read.parquet(str(tmp_path / "dec")).collect()} == {("a", 2), ("b", 3)}


def test_trailing_state_is_one_list_a_key(spark, tmp_path):
    """a key's calls of the state do not grow with the time its rows span, and rows too old leave the list."""
    hour, window = 3_600_000, 5 * 3_600_000
    batches = [[(k, (40 * b + i + 1) * hour, float(i + b)) for k in "ab" for i in range(40)] for b in range(3)]
    q = streams.trailing_stream(in_turn(spark, tmp_path, batches, "k string, ms long, v double"), "k", "ms", "v", window).writeStream.format("memory").queryName("one_list").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"]) <= 20
    everything = {(k, ms): v for batch in batches for k, ms, v in batch}
    want = {(k, ms): [x for (kk, at), x in everything.items() if kk == k and ms - window <= at <= ms] for k, ms in everything}
    assert {(r.k, r.ms): (r.n, r.total) for r in spark.table("one_list").collect()} == {at: (len(x), sum(x)) for at, x in want.items()}
