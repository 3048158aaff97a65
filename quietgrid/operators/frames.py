"""Frame-level predictions and labels: joins, dilation, smoothing, events, windows.

Frames have a sample, an integer frame index, a flag ``present`` (0/1) and a ``count``.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .tables import durable

BOXES = "array<struct<xyxy:array<double>,conf:double,class_id:int>>"


def join_frames(pred: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("sample", "frame")) -> DataFrame:
    return pred.join(labels, list(keys))


def semi_split(df: DataFrame, manifest: DataFrame, split: str, key: str = "sample") -> DataFrame:
    return df.join(manifest.where(F.lower("split") == split.lower()).select(key), key, "left_semi")


def filter_split(df: DataFrame, split: str | None, most: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of a split, case-insensitive; all rows if no split is given or the column is missing; then the first ``most`` in order."""
    if split is not None and "split" in df.columns:
        df = df.where(F.lower("split") == split.lower())
    return df.orderBy(*order).limit(most) if most is not None and order else df


def dilate_labels(df: DataFrame, pre: int, post: int, sample: str = "sample", frame: str = "frame") -> DataFrame:
    """A frame is present if a present frame of its sample is no more than ``pre`` after or ``post`` before it; raw columns are kept."""
    w = Window.partitionBy(sample).orderBy(frame).rangeBetween(-post, pre)
    return df.withColumns({"raw_present": F.col("present"), "raw_count": F.col("count"), "present": F.max("present").over(w)}).withColumn("count", F.when(F.col("present") == 1, F.greatest("raw_count", F.lit(1))).otherwise(0))


def fill_gaps(df: DataFrame, most: int, sample: str = "sample", frame: str = "frame") -> DataFrame:
    """Frames between two present frames no more than ``most`` apart are present too."""
    w = Window.partitionBy(sample).orderBy(frame)
    at = F.when(F.col("present") == 1, F.col(frame))
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("present", F.when(after - before <= most, 1).otherwise(F.col("present")))


def drop_short_runs(df: DataFrame, least: int, sample: str = "sample", order: list[str] | None = None) -> DataFrame:
    """Runs of fewer than ``least`` present rows are cleared; counts follow."""
    order = order or ["frame"]
    w = Window.partitionBy(sample).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(sample, "present").orderBy(*order))
    size = F.count("*").over(Window.partitionBy(sample, "present", "_island"))
    df = df.withColumn("_island", island).withColumn("_size", size)
    df = df.withColumn("present", F.when((F.col("present") == 1) & (F.col("_size") < least), 0).otherwise(F.col("present")))
    return df.withColumn("count", F.when(F.col("present") == 1, F.greatest("count", F.lit(1))).otherwise(0)).drop("_island", "_size")


def presence_events(df: DataFrame, gap: int = 1, sample: str = "sample", frame: str = "frame") -> DataFrame:
    """(sample, event_start, event_end, duration, rows, max_count): present frames no more than ``gap`` apart make one event."""
    w = Window.partitionBy(sample).orderBy(frame)
    on = df.where("present = 1").withColumn("_new", (F.col(frame) > F.lag(frame).over(w) + gap).cast("int"))
    on = on.withColumn("_event", F.sum(F.coalesce("_new", F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    out = on.groupBy(sample, "_event").agg(F.min(frame).alias("event_start"), F.max(frame).alias("event_end"), F.count("*").alias("rows"), F.max("count").alias("max_count"))
    return out.select(sample, "event_start", "event_end", (F.col("event_end") - F.col("event_start") + 1).alias("duration"), "rows", "max_count")


def match_events(true: DataFrame, pred: DataFrame, tolerance: int = 0, sample: str = "sample") -> DataFrame:
    """(sample, tp, fp, fn, precision, recall, f1, f2) of events (sample, event_start, event_end).

    Predictions in order of start and end take the unmatched true event with the largest overlap, the first of
    equals; the tolerance widens true events.  A prediction can only take an event of its own run of overlapping
    events, so the greedy pass runs over runs, however many of them a sample has.
    """
    side = lambda df, wide, is_true: df.select(sample, (F.col("event_start") - wide).cast("long").alias("a"), (F.col("event_end") + wide).cast("long").alias("b"), F.lit(is_true).alias("true"))
    events = side(true, tolerance, True).unionByName(side(pred, 0, False))
    runs = intervals.overlap_runs(events.where("a <= b"), sample, "a", "b")
    hits = intervals.greedy_hits(runs, sample).groupBy(sample).agg(F.sum("hits").alias("tp"))
    n = events.groupBy(sample).agg(F.count_if("true").alias("nt"), F.count_if(~F.col("true")).alias("np"))
    hits = hits.select(F.col(sample).alias("_s"), "tp")
    n = n.join(hits.hint("merge"), n[sample].eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0, ["tp"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("np") - F.col("tp"), F.col("nt") - F.col("tp")
    return n.select(sample, "tp", fp.alias("fp"), fn.alias("fn"), ratio(tp, F.col("np")).alias("precision"), ratio(tp, F.col("nt")).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(5 * tp, 5 * tp + fp + 4 * fn).alias("f2"))


def align_truth(pred: DataFrame, truth: DataFrame, sample: str = "sample", frame: str = "frame") -> DataFrame:
    """Predictions with ``truth``, 0 where a frame has none; samples without any truth are left out."""
    known = pred.join(truth.select(sample).distinct(), sample, "left_semi")
    return known.join(truth.select(sample, frame, F.col("present").alias("truth")), [sample, frame], "left").fillna(0, ["truth"])


def label_windows(windows: DataFrame, marked: DataFrame, least: float = 0.10, sample: str = "sample") -> DataFrame:
    """Windows (sample, window, start, end) labelled fall where one of the intervals ``marked`` covers ``least`` of them."""
    keys = [sample, "window", "start", "end"]
    share = F.col("overlap") / (F.col("end") - F.col("start") + 1)
    found = intervals.widest_overlap(windows.select(*keys), marked, sample, keys)
    return found.select(*keys, F.when(share >= least, "fall").otherwise("nonfall").alias("label"))


def sequence_windows(df: DataFrame, n: str, length: int, stride: int) -> DataFrame:
    """(.., start): starts of windows over n poses; the last window is flush with the end, a short sequence has one."""
    last = F.greatest(F.col(n) - length, F.lit(0))
    return df.withColumn("start", F.explode(F.array_sort(F.array_union(F.sequence(F.lit(0), last.cast("int"), F.lit(stride)), F.array(last.cast("int"))))))


def eventize_clips(df: DataFrame, least: int, how: str = "max", sample: str = "sample") -> DataFrame:
    """(sample, positives, present, count) of each clip."""
    agg = {"max": F.max, "mean": F.avg}[how]
    return df.groupBy(sample).agg(F.sum("present").alias("positives"), agg("count").cast("double").alias("count")).withColumn("present", (F.col("positives") >= least).cast("int"))


def recompute_from_boxes(df: DataFrame, confidence: float, area: float, boxes: str = "boxes_json") -> DataFrame:
    """Counts the boxes that are sure and large enough; without a boxes column nothing changes."""
    if boxes not in df.columns:
        return df
    size = lambda b: F.greatest(F.lit(0.0), b["xyxy"][2] - b["xyxy"][0]) * F.greatest(F.lit(0.0), b["xyxy"][3] - b["xyxy"][1])
    kept = F.filter(F.coalesce(F.from_json(boxes, BOXES), F.array().cast(BOXES)), lambda b: (b["conf"] >= confidence) & (size(b) >= area))
    df = df.withColumn("_kept", kept)
    return df.withColumns({"count": F.size("_kept"), "present": (F.size("_kept") > 0).cast("int"), "max_conf": F.coalesce(F.array_max(F.transform("_kept", lambda b: b["conf"])), F.lit(0.0))}).drop("_kept")


def crop_plan(boxes: DataFrame, key: list[str], width: int, height: int, pad: float = 0.10) -> DataFrame:
    """(key, x1, y1, x2, y2): the largest box of a key (of equals the least by x1, y1, x2, y2) with a margin, clamped to the frame."""
    big = boxes.groupBy(*key).agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), -F.col("x1"), -F.col("y1"), -F.col("x2"), -F.col("y2"))).alias("b"))
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    return big.select(*key, F.greatest(F.lit(0.0), F.col("b.x1") - pad * w).alias("x1"), F.greatest(F.lit(0.0), F.col("b.y1") - pad * h).alias("y1"), F.least(F.lit(float(width)), F.col("b.x2") + pad * w).alias("x2"), F.least(F.lit(float(height)), F.col("b.y2") + pad * h).alias("y2"))


def semantic_summary(df: DataFrame) -> DataFrame:
    """Adds labels, count, occupied and confidence of a payload with labels, detections (label, conf), counts (label -> n) and occupied."""
    labels = F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce(F.transform("detections", lambda d: d["label"]), F.array().cast("array<string>")), F.coalesce(F.flatten(F.transform(F.map_entries("counts"), lambda e: F.array_repeat(e["key"], e["value"]))), F.array().cast("array<string>")))
    people = F.size(F.filter(labels, lambda x: F.lower(x) == "person"))
    count = F.greatest(people, F.coalesce("count", F.lit(0)))
    return df.select("*", labels.alias("all_labels"), count.alias("people"), F.coalesce(F.col("occupied"), count > 0).alias("is_occupied"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["conf"])), F.lit(0.0)).alias("confidence"))


def _threshold_runs(rows: DataFrame, sample: str, frame: str, dilations: int, n_levels: int) -> DataFrame:
    """(sample, level, a, b, row_a, row_b, seg_a, seg_b, before, after): runs of consecutive rows of that level or above.

    A row begins a run of each level between its own and that of the row before, and ends one of each level between
    its own and that of the row after: the runs of all levels come from one pass over the rows.  ``before`` and
    ``after`` count joined rows and true ones up to the run and with it.
    """
    w = Window.partitionBy(sample).orderBy(frame)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = F.array(F.sum("joined").over(upto), *[F.sum(F.coalesce(F.col("truth")[d], F.lit(0))).over(upto) for d in range(dilations)])
    own = F.array(F.col("joined"), *[F.coalesce(F.col("truth")[d], F.lit(0)) for d in range(dilations)])
    rows = rows.withColumns({"row": F.row_number().over(w), "prev": F.lag("level", 1, 0).over(w), "next": F.lead("level", 1, 0).over(w), "held": held, "own": own})
    span = lambda lo: F.when(F.col("level") > F.col(lo), F.sequence(F.col(lo) + 1, F.col("level"))).otherwise(F.array().cast("array<int>"))
    before = F.zip_with("held", "own", lambda x, y: x - y)
    mark = lambda ends: lambda j: F.struct(j.alias("level"), F.lit(ends).alias("ends"))
    edges = rows.select(sample, F.col(frame).alias("at"), "row", "seg", before.alias("before"), F.col("held").alias("after"), F.inline(F.concat(F.transform(span("prev"), mark(0)), F.transform(span("next"), mark(1)))))
    pair = Window.partitionBy(sample, "level").orderBy("row", "ends")
    to = lambda c: F.lead(c).over(pair)
    runs = edges.select(sample, "level", "ends", F.col("at").alias("a"), to("at").alias("b"), F.col("row").alias("row_a"), to("row").alias("row_b"), F.col("seg").alias("seg_a"), to("seg").alias("seg_b"), "before", to("after").alias("after"))
    return runs.where("ends = 0").drop("ends")


def _joined_runs(df: DataFrame, keys: list[str], gap: Column, start: str, end: str, *aggs: Column) -> DataFrame:
    """Consecutive intervals of a group as one where the next begins no more than ``gap`` after the end of the one before."""
    w = Window.partitionBy(*keys).orderBy(start)
    apart = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(True)).cast("int")
    numbered = df.withColumn("_apart", apart).withColumn("_number", F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_number").agg(F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("_number")


SCORES = ("f1", "f2", "precision", "recall", "event_f1", "event_f2")


def tune_postprocess(pred: DataFrame, labels: DataFrame, confidences: list[float], dilations: list[int], least_runs: list[int], gaps: list[int], event_gap: int = 30, tolerance: int = 30, metric: str = "f2", sample: str = "sample", frame: str = "frame") -> DataFrame:
    """(config, confidence, dilation, least_run, gap, tp, fp, fn, the SCORES, presence and event, score, best, error) of every configuration.

    Predictions (sample, frame, score) are present from a confidence on; absent rows between two present ones no more
    than ``gap`` frames apart are filled, then runs of fewer than ``least_run`` rows are cleared.  Labels (sample, frame,
    present) are dilated by ``dilation`` frames both ways.  Frames are compared where both have a row, and events
    (present rows no more than ``event_gap`` apart) are matched with the tolerance.  ``best`` marks the first
    configuration of the highest score; one that cannot be scored has an error and no scores.

    No row is copied for a configuration: runs come from one pass for all confidences, and gaps, lengths, dilations
    and matches work on runs and events.
    """
    if metric not in SCORES:
        raise ValueError(f"metric is one of {SCORES}")
    spark, steps, nd = pred.sparkSession, sorted({c for c in confidences if c is not None}), len(dilations)
    around = lambda d: Window.partitionBy(sample).orderBy(frame).rangeBetween(-max(d, 0), max(d, 0))
    dilated = labels.select(sample, frame, F.array(*[F.max("present").over(around(d or 0)) for d in dilations]).alias("truth"))
    level = sum((F.coalesce(F.col("score") >= c, F.lit(False)).cast("int") for c in steps), F.lit(0))
    w = Window.partitionBy(sample).orderBy(frame)
    rows = pred.select(sample, frame, level.alias("level")).join(dilated.hint("merge"), [sample, frame], "left").withColumn("joined", F.col("truth").isNotNull().cast("int"))
    rows = rows.withColumn("seg", F.sum((F.coalesce(F.col(frame) - F.lag(frame).over(w), F.lit(0)) > event_gap).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = durable(rows, "rows")
    totals = rows.agg(F.sum("joined"), *[F.sum(F.coalesce(F.col("truth")[d], F.lit(0))) for d in range(nd)]).first()

    # runs by level and gap, then by least length
    runs = _threshold_runs(rows, sample, frame, nd, len(steps)).withColumn("gap", F.explode(F.array(*[F.lit(g) for g in sorted({g for g in gaps if g is not None})])))
    first, last = lambda c: F.min_by(c, "row_a").alias(c), lambda c: F.max_by(c, "row_a").alias(c)
    reach = F.when(F.col("gap") > 0, F.col("gap")).otherwise(F.lit(-1))
    runs = _joined_runs(runs, [sample, "level", "gap"], reach, "a", "b", first("seg_a"), last("seg_b"), first("before"), last("after"), (F.max("row_b") - F.min("row_a") + 1).alias("n"))
    wanted = F.array(*[F.lit(m) for m in sorted({m for m in least_runs if m is not None})])
    runs = durable(runs.withColumn("least_run", F.explode(F.filter(wanted, lambda m: F.col("n") >= m))), "runs")
    keys = ["level", "gap", "least_run"]
    gained = lambda i: F.sum(F.col("after")[i] - F.col("before")[i])
    counted = runs.groupBy(*keys).agg(gained(0).alias("positive"), F.array(*[gained(d + 1) for d in range(nd)]).alias("hits"))

    # events: a run is cut where its own rows lie further apart than an event may
    segs = rows.groupBy(sample, "seg").agg(F.min(frame).alias("_low"), F.max(frame).alias("_high"))
    cut = runs.where("seg_a < seg_b").withColumn("seg", F.explode(F.sequence("seg_a", "seg_b"))).join(segs.hint("merge"), [sample, "seg"])
    pieces = runs.where("seg_a = seg_b").select(sample, *keys, "a", "b").unionByName(cut.select(sample, *keys, F.greatest("a", "_low").alias("a"), F.least("b", "_high").alias("b")))
    guessed = durable(_joined_runs(pieces, [sample, *keys], F.lit(event_gap), "a", "b"), "guessed")
    on = lambda d: F.when(F.col("truth")[d] == 1, F.col(frame))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    edge = [
        F.when(F.col("truth")[d] == 1, F.struct(
            F.lit(d).alias("d"),
            F.coalesce(F.col(frame) - F.last(on(d), ignorenulls=True).over(before) > event_gap, F.lit(True)).alias("begins"),
            F.coalesce(F.first(on(d), ignorenulls=True).over(after) - F.col(frame) > event_gap, F.lit(True)).alias("ends"),
        ))
        for d in range(nd)
    ]
    edges = dilated.select(sample, frame, F.array_compact(F.array(*edge)).alias("e")).select(sample, frame, F.inline("e"))
    side = Window.partitionBy(sample, "d").orderBy(frame, "ends")
    marks = edges.where("begins or ends").withColumn("_to", F.when(F.col("ends"), F.col(frame)).otherwise(F.lead(frame).over(side)))
    real = durable(marks.where("begins").select(sample, "d", F.col(frame).alias("a"), F.col("_to").alias("b")), "real")

    grid = [(i, *x) for i, x in enumerate(product(confidences, dilations, least_runs, gaps))]
    number = {c: i + 1 for i, c in enumerate(steps)}
    table = [(i, c, d, m, g, number.get(c), dilations.index(d)) for i, c, d, m, g in grid]
    table = spark.createDataFrame(table, "config int, confidence double, dilation int, least_run int, gap int, level int, d int")
    asked = F.broadcast(table.select("config", *keys, "d"))  # the authored grid
    own = F.concat_ws("|", "config", sample).alias("whose")
    sides = [guessed.join(asked, keys).select("config", own, "a", "b", F.lit(False).alias("true")), real.join(asked, "d").select("config", own, (F.col("a") - tolerance).alias("a"), (F.col("b") + tolerance).alias("b"), F.lit(True).alias("true"))]
    events = durable(sides[0].unionByName(sides[1]).select("config", "whose", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "true"), "events")
    found = intervals.greedy_hits(intervals.overlap_runs(events, "whose", "a", "b"), "whose")
    found = found.groupBy(F.split_part("whose", F.lit("|"), F.lit(1)).cast("int").alias("config")).agg(F.sum("hits").alias("e_tp"))
    sizes = events.groupBy("config").agg(F.count_if("true").alias("e_true"), F.count_if(~F.col("true")).alias("e_pred"))

    out = table.join(counted.hint("merge"), keys, "left").join(sizes.hint("merge"), "config", "left").join(found.hint("merge"), "config", "left").fillna(0, ["positive", "e_tp", "e_true", "e_pred"])
    total = F.element_at(F.array(*[F.lit(x or 0).cast("long") for x in totals[1:]]), F.col("d") + 1)
    tp = F.coalesce(F.element_at("hits", F.col("d") + 1), F.lit(0)).cast("long")
    out = out.withColumns({"tp": tp, "fp": F.col("positive") - tp, "fn": total - tp})
    wrong = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in ("confidence", "dilation", "least_run", "gap")]) | (F.col("dilation") < 0)
    out = out.withColumn("error", F.when(wrong, "a parameter is missing or negative").when(F.lit(not totals[0]), "no matching rows between predictions and labels"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def scores(tp: Column, pred_n: Column, true_n: Column, name: str) -> dict[str, Column]:
        p, r = ratio(tp, pred_n), ratio(tp, true_n)
        both = {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "f2": ratio(5 * p * r, 4 * p + r)}
        return {f"{name}{k}": F.when(F.col("error").isNull(), v) for k, v in both.items()}

    out = out.withColumns(scores(F.col("tp"), F.col("positive"), F.col("tp") + F.col("fn"), "") | scores(F.col("e_tp"), F.col("e_pred"), F.col("e_true"), "event_"))
    out = out.withColumn("score", F.col(metric))
    everything = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("score"), "config")  # a row a configuration
    out = out.withColumn("best", (F.row_number().over(everything) == 1) & F.col("score").isNotNull())
    counts = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("tp", "fp", "fn")]
    return out.select("config", "confidence", "dilation", "least_run", "gap", *counts, "precision", "recall", "f1", "f2", "event_precision", "event_recall", "event_f1", "event_f2", "score", "best", "error")


def join_semantic(manifest: DataFrame, outputs: DataFrame, sample: str, order: str, most: int = 64) -> DataFrame:
    """Manifest rows with the labels of their first ``most`` artifacts in order, the highest confidence, and the first label as prediction."""
    r = F.row_number().over(Window.partitionBy(sample).orderBy(order))
    first = outputs.withColumn("_r", r).where(F.col("_r") <= most)
    agg = first.groupBy(sample).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_r", "labels"))), lambda x: x["labels"])).alias("labels"), F.max("confidence").alias("confidence"))
    return manifest.join(agg, sample, "left").withColumn("pred", F.try_element_at("labels", F.lit(1)))
