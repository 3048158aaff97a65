"""Operator chains through the schema adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietgrid.functions import caps
from quietgrid.operators import select

CAP = "op string, in_type string, in_schema string, out_type string, out_schema string"


def allowed(spark, rows):
    df = spark.createDataFrame(rows, "ut string, us string, tt string, ts string")
    return [r[0] for r in df.select(caps.adapter_allowed(F.col("ut"), F.col("us"), F.col("tt"), F.col("ts"))).collect()]


def test_adapter_schemas(spark):
    x = "application/x-"
    yes = [
        (f"{x}aggregate", "aggregate_summary", f"{x}occupancy-count", "occupancy_count"), (f"{x}detections", "object_detections", f"{x}occupancy-count", "occupancy_count"), (f"{x}pose-keypoints", "pose_keypoints", f"{x}motion-features", "normalized_motion_features"),
        (f"{x}security-event", "person_at_door_or_intrusion_event", f"{x}activity-label", "activity_label"), (f"{x}occupancy-count", "occupancy_count", f"{x}binary-occupancy", "room_occupied"), (f"{x}detections", None, f"{x}occupancy-count", "occupancy_count"), ("video/x-raw", "", "video/x-redacted", ""),
    ]
    no = [
        (f"{x}motion-features", "normalized_motion_features", f"{x}sound-event", "sound_event_label"), (f"{x}activity-label", "activity_label", f"{x}security-event", "person_at_door_or_intrusion_event"), (f"{x}occupancy-count", "occupancy_count", f"{x}aggregate", "aggregate_summary"),
        (f"{x}detections", "own_schema", f"{x}occupancy-count", "occupancy_count"), (f"{x}detections", "object_detections", "", ""), ("video/x-raw", "", f"{x}detections", ""),
    ]
    assert allowed(spark, yes) == [True] * len(yes)
    assert allowed(spark, no) == [False] * len(no)


def test_chains_go_on_from_the_output_made(spark):
    x = "application/x-"
    ops = [
        ("detect", "video/x-raw", "", f"{x}detections", "object_detections"), (caps.ADAPTER, "*", "", f"{x}occupancy-count", "occupancy_count"), (caps.ADAPTER, "*", "", f"{x}activity-label", "activity_label"), ("report", f"{x}occupancy-count", "occupancy_count", f"{x}aggregate", "aggregate_summary"),
        ("source", "", "none", "video/x-raw", ""), ("label", f"{x}activity-label", "activity_label", f"{x}decibel-level", "decibel_level_duration"),
    ]
    steps = caps.compatible_steps(spark.createDataFrame(ops, CAP).where("op <> 'source' or in_schema = 'none'"))
    start = spark.createDataFrame([("detect", f"{x}detections", "object_detections")], "op string, type string, schema string")
    paths = {">".join(r.path) for r in select.expand_steps(steps.where("b <> 'source'"), start, 7).collect()}
    # the adapter makes a count of detections, never a label, and stands in a chain once
    assert paths == {"detect", f"detect>{caps.ADAPTER}", f"detect>{caps.ADAPTER}>report"}


def test_depth_seven(spark):
    steps = spark.createDataFrame([(f"o{i}", "t", "s", f"o{i + 1}", "t", "s") for i in range(9)] + [("o3", "t", "s", "o1", "t", "s")], "a string, a_type string, a_schema string, b string, b_type string, b_schema string")
    start = spark.createDataFrame([("o0", "t", "s")], "op string, type string, schema string")
    got = sorted(len(r.path) for r in select.expand_steps(steps, start).collect())
    assert got == [1, 2, 3, 4, 5, 6, 7]
