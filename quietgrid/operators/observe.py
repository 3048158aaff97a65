"""Operators over observations; the same functions serve batch and streaming frames unless they say otherwise.

An observation has annotations ARRAY<STRUCT<label, confidence>>, readings MAP<STRING, DOUBLE> and columns
that name its source and time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


def normalize_keypoints(joints: DataFrame, pose: list[str], confidence: str, least: float = 0.05) -> DataFrame:
    """Joints (x, y) centred on the mean of the sure joints of their pose and divided by the diagonal of those, one at least."""
    w = Window.partitionBy(*pose)
    sure = lambda n: F.when(F.col(confidence) > least, F.col(n))
    span = lambda n: F.max(sure(n)).over(w) - F.min(sure(n)).over(w)
    size = F.coalesce(F.greatest(F.lit(1.0), F.sqrt(span("x") * span("x") + span("y") * span("y"))), F.lit(1.0))
    return joints.withColumns({n: (F.col(n) - F.coalesce(F.avg(sure(n)).over(w), F.lit(0.0))) / size for n in "xy"})


def gate_condition(condition: str | bool, least: float = 0.0) -> Column:
    """The predicate of a trigger: always, a reading compared with a number, an annotation, or the presence of a reading; anything else is false."""
    if condition is True or str(condition).strip().lower() in ("always", "true"):
        return F.lit(True)
    text = str(condition).strip()
    if text.startswith("annotation:"):
        label = text.split(":", 1)[1].strip().lower()
        return F.exists("annotations", lambda a: (F.lower(a["label"]) == label) & (F.coalesce(a["confidence"], F.lit(1.0)) >= least))
    if text.startswith("data_exists:"):
        return F.map_contains_key("readings", text.split(":", 1)[1].strip())
    if m := re.fullmatch(r"(\w+)\s*(>=|<=|==|>|<)\s*(-?[\d.]+)", text):
        return COMPARE[m[2]](F.coalesce(F.col("readings")[m[1]], F.lit(0.0)), F.lit(float(m[3])))
    return F.lit(False)


def trigger_gate(df: DataFrame, condition: str | bool, least: float = 0.0) -> DataFrame:
    return df.where(gate_condition(condition, least))


def drop_discard(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def _people(labels: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.coalesce("annotations", F.array().cast("array<struct<label:string,confidence:double>>")), lambda a: F.lower(a["label"]).isin(*labels)))


def adapt_occupancy(df: DataFrame) -> DataFrame:
    """Adds occupied and count: a count of 0 or none falls through to occupancy_count, then to occupied alone, then to person annotations."""
    r = F.col("readings")
    given = F.coalesce(F.nullif(r["count"], F.lit(0.0)), r["occupancy_count"])
    count = F.when(given.isNull() & r["occupied"].isNotNull(), (r["occupied"] != 0).cast("int")).otherwise(F.coalesce(F.nullif(given.cast("int"), F.lit(0)), _people(("person",))))
    return df.withColumn("count", count.cast("int")).withColumn("occupied", F.col("count") > 0)


def adapt_labels(df: DataFrame) -> DataFrame:
    """Adds labels (those of the annotations that have one) and the highest confidence, 0 if none."""
    confidence = F.coalesce(F.array_max(F.transform("annotations", lambda a: F.coalesce(a["confidence"], F.lit(0.0)))), F.lit(0.0))
    return df.withColumn("labels", F.filter(F.transform("annotations", lambda a: a["label"]), lambda x: x.isNotNull() & (x != ""))).withColumn("confidence", confidence)


def derive_occupancy(df: DataFrame, threshold: float = 0.5, binary: bool = False) -> DataFrame:
    """Adds count: a reading ``count``; else motion, occupied or value (0 is as if missing) against the threshold; else person and face annotations."""
    r = F.col("readings")
    truthy = F.coalesce(F.nullif(r["motion"], F.lit(0.0)), F.nullif(r["occupied"], F.lit(0.0)), r["value"])
    df = df.withColumn("count", F.coalesce(r["count"].cast("int"), (truthy >= threshold).cast("int"), _people(("person", "face"))))
    return df.withColumn("occupied", F.col("count") > 0) if binary else df


def count_by_label(df: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """(keys, label, n); rows without a label count as unknown."""
    return df.groupBy(*keys, F.coalesce(F.nullif(label, F.lit("")), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def loudness(level: Column, loud: float = -15, quiet: float = -45) -> Column:
    return F.when(level >= loud, "loud").when(level <= quiet, "quiet").otherwise("normal")


def aggregate_generalize(df: DataFrame, keys: list[str], ts: str, every: str, label: Column) -> DataFrame:
    """Counts of labels by key and calendar unit, as a map."""
    counted = count_by_label(df.withColumn("bucket", F.date_trunc(every, ts)), [*keys, "bucket"], label)
    return counted.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("counts"), F.sum("n").alias("total"))


def trailing_window(df: DataFrame, key: str, ms: str, window_ms: int, value: Column) -> DataFrame:
    """Adds items: the values of the key's rows no more than ``window_ms`` before this one, itself and its peers included; rows without a positive time keep only their own."""
    w = Window.partitionBy(key, F.col(ms) > 0).orderBy(ms).rangeBetween(-window_ms, 0)
    return df.withColumn("items", F.when(F.col(ms) > 0, F.sort_array(F.collect_list(value).over(w))).otherwise(F.array(value)))


def fuse_events(df: DataFrame, ts: str, seconds: int, label: str) -> DataFrame:
    """(bucket, labels): the distinct labels of a time bucket, sorted, with ``fused_event`` at the end."""
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds)
    return df.groupBy(bucket.alias("bucket")).agg(F.array_append(F.array_sort(F.collect_set(label)), F.lit("fused_event")).alias("labels"), F.count("*").alias("n"))


def motion_features(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, mean, sd, step): mean, population deviation and mean absolute change of a value in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w))).groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("step"))


def region_union(boxes: DataFrame, key: list[str], pad: int, width: int, height: int, label: str | None = None, frames: DataFrame | None = None) -> DataFrame:
    """(key, x1, y1, x2, y2): the smallest box around the boxes of a key, of one label if it is named, padded and clamped to the frame.

    With ``frames`` (key, region STRUCT) each of its keys has a row: its own region where it has one, the whole
    frame where no box is left.
    """
    low = lambda n: F.greatest(F.lit(0), F.min(n) - pad).alias(n)
    boxes = boxes if label is None else boxes.where(F.col("label") == label)
    found = boxes.groupBy(*key).agg(low("x1"), low("y1"), F.least(F.lit(width), F.max("x2") + pad).alias("x2"), F.least(F.lit(height), F.max("y2") + pad).alias("y2"))
    if frames is None:
        return found
    whole = {"x1": 0, "y1": 0, "x2": width, "y2": height}
    joined = frames.select(*key, "region").join(found.hint("merge"), key, "left")
    return joined.select(*key, *[F.coalesce(F.col("region")[n], F.col(n), F.lit(v)).alias(n) for n, v in whole.items()])


def best_pose(poses: DataFrame, key: list[str], pose: str, confidence: str) -> DataFrame:
    """(key, pose): the pose of the highest mean joint confidence, ties to the smaller pose."""
    return poses.groupBy(*key).agg(F.max_by(pose, F.struct(F.col(confidence), -F.xxhash64(pose))).alias(pose))


def stride_rows(df: DataFrame, key: str, order: list[str], stride: int, most: int) -> DataFrame:
    """Every stride-th row of a key, ``most`` of them."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("_n", n).where((F.col("_n") % stride == 0) & (F.col("_n") < stride * most)).drop("_n")


def sample_evenly(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """n evenly spaced rows of a key, its ends included (the middle one if n is 1), each once; places are rounded half-even."""
    w = Window.partitionBy(key)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count("*").over(w))
    places = F.array(F.floor(F.col("_m") / 2).cast("int")) if n <= 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * ((F.col("_m") - 1) / F.lit(float(max(1, n - 1)))), 0).cast("int"))
    return df.where(F.array_contains(places, F.col("_i"))).drop("_i", "_m")


def classify_activity(labels: Column, fallen: Column, people: Column) -> Column:
    """Activity by sound labels, then pose, then detections, else unknown; the inputs may be null."""
    alarm, speech = (F.coalesce(F.exists(labels, f), F.lit(False)) for f in (lambda x: x.contains("glass") | x.contains("alarm"), lambda x: x.contains("speech")))
    return (
        F.when(alarm, "glass_break_or_alarm").when(speech, "conversation_or_speech_present")
        .when(fallen, "fall").when(~fallen, "posture_activity").when(people > 0, "person_present").when(people == 0, "no_person").otherwise("unknown")
    )
