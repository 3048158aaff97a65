"""Privacy probes: what a table of outputs still discloses, as ordinal levels (0 none .. 3 high) by key.

Each probe returns the key and one column for each attribute it speaks about; keys without rows are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, LOW, MEDIUM, HIGH, UNKNOWN = range(5)
PRIVATE_OBJECTS = ("bed", "toilet", "sink", "couch", "tv", "laptop", "book")
TEXT_OBJECTS = ("laptop", "book")


def steps(value: Column, *limits: tuple[int, int], over: int) -> Column:
    """The level of the first limit that the value does not exceed, else ``over``."""
    out = F.lit(over)
    for limit, level in reversed(limits):
        out = F.when(value <= limit, level).otherwise(out)
    return out


def probe_presence(df: DataFrame, key: list[str], count: Column, occupied: Column) -> DataFrame:
    """Any counts: presence high, co-presence high from two people on, else low.  Occupied flags alone: medium.  Activity and location are low where anybody was seen."""
    agg = df.groupBy(*key).agg(F.count(count).alias("_n"), F.max(count).alias("_max"), F.count(occupied).alias("_o"), F.coalesce(F.max((F.coalesce(count, F.lit(0)) > 0) | F.coalesce(occupied, F.lit(False))), F.lit(False)).alias("_seen"))
    low = F.when(F.col("_seen"), LOW).otherwise(NONE)
    return agg.select(*key, F.when(F.col("_n") > 0, HIGH).when(F.col("_o") > 0, MEDIUM).otherwise(NONE).alias("aggregate_presence"), F.when(F.col("_n") > 0, F.when(F.col("_max") >= 2, HIGH).otherwise(LOW)).otherwise(NONE).alias("co_presence"), low.alias("activity"), low.alias("location"))


def probe_trajectory(points: DataFrame, key: list[str], track: str) -> DataFrame:
    """Points of tracks: location medium, trajectory high if a track has three points, identity low, co-presence medium from two tracks on."""
    tracks = points.groupBy(*key, track).agg(F.count("*").alias("_n"))
    return tracks.groupBy(*key).agg(F.lit(MEDIUM).alias("location"), F.when(F.max("_n") >= 3, HIGH).otherwise(MEDIUM).alias("trajectory"), F.lit(LOW).alias("identity"), F.when(F.count("*") >= 2, MEDIUM).otherwise(NONE).alias("co_presence"))


def probe_routine(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """A day of hourly rows with any time: activity and presence medium, location low; a week: high, high, medium."""
    n = df.groupBy(*key).agg(F.when(F.count(ts) > 0, F.count("*")).otherwise(0).alias("_n"))
    at = lambda day, week: F.when(F.col("_n") >= 168, week).when(F.col("_n") >= 24, day).otherwise(NONE)
    return n.select(*key, at(MEDIUM, HIGH).alias("activity"), at(MEDIUM, HIGH).alias("aggregate_presence"), at(LOW, MEDIUM).alias("location"))


def probe_faces(detections: DataFrame, key: list[str], frame: str, ratio: str) -> DataFrame:
    agg = detections.groupBy(*key).agg(F.count("*").alias("_n"), F.countDistinct(frame).alias("_f"), F.max(ratio).alias("_r"))
    return agg.select(*key, steps(F.col("_n"), (0, NONE), (1, LOW), (5, MEDIUM), over=HIGH).alias("face"), F.when((F.col("_r") > 0.03) & (F.col("_f") >= 2), MEDIUM).when(F.col("_n") > 0, LOW).otherwise(NONE).alias("identity"))


def probe_persons(detections: DataFrame, key: list[str], frame: str, ratio: str) -> DataFrame:
    agg = detections.groupBy(*key).agg(F.count("*").alias("_n"), F.countDistinct(frame).alias("_f"), F.max(ratio).alias("_r"))
    body = F.when(F.col("_r") > 0.05, MEDIUM).otherwise(LOW)
    return agg.select(*key, body.alias("body_shape"), body.alias("clothing"), F.when(F.col("_n") >= 2, MEDIUM).otherwise(LOW).alias("co_presence"), F.when(F.col("_f") >= 2, LOW).otherwise(NONE).alias("trajectory"), F.lit(HIGH).alias("aggregate_presence"))


def probe_text(tokens: DataFrame, key: list[str], token: str) -> DataFrame:
    agg = tokens.groupBy(*key).agg(F.count(token).alias("_n"), F.count_if(F.col(token).rlike(r"\d") | (F.length(token) >= 8)).alias("_id"))
    return agg.select(*key, steps(F.col("_n"), (0, NONE), (3, LOW), (15, MEDIUM), over=HIGH).alias("visible_text"), F.when(F.col("_id") > 0, LOW).otherwise(NONE).alias("identity"))


def probe_scene(objects: DataFrame, key: list[str], label: str) -> DataFrame:
    has = lambda xs: F.max(F.lower(label).isin(*xs))
    return objects.groupBy(*key).agg(F.when(has(PRIVATE_OBJECTS), MEDIUM).otherwise(LOW).alias("location"), F.lit(LOW).alias("activity"), F.when(has(TEXT_OBJECTS), LOW).otherwise(NONE).alias("visible_text"))


def probe_speech(transcripts: DataFrame, key: list[str], text: str) -> DataFrame:
    n = transcripts.groupBy(*key).agg(F.sum(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9']+"), F.lit(0)))).alias("_n"))
    return n.select(*key, steps(F.col("_n"), (0, NONE), (3, LOW), (20, MEDIUM), over=HIGH).alias("speech_content"), F.when(F.col("_n") > 0, LOW).otherwise(NONE).alias("activity"))


def probe_speakers(turns: DataFrame, key: list[str], speaker: str) -> DataFrame:
    n = turns.groupBy(*key).agg(F.countDistinct(speaker).alias("_n"))
    return n.select(*key, steps(F.col("_n"), (0, NONE), (1, LOW), over=MEDIUM).alias("speaker_identity"), F.when(F.col("_n") > 1, HIGH).otherwise(NONE).alias("co_presence"))


def probe_audio_presence(clips: DataFrame, key: list[str], seconds: str) -> DataFrame:
    s = clips.groupBy(*key).agg(F.coalesce(F.sum(seconds), F.lit(0)).alias("_s"))
    return s.select(*key, F.when(F.col("_s") > 0, LOW).otherwise(NONE).alias("aggregate_presence"), F.when(F.col("_s") >= 60, MEDIUM).when(F.col("_s") > 0, LOW).otherwise(NONE).alias("activity"))


def to_long(probe: DataFrame, key: list[str]) -> DataFrame:
    """(key, attr, level) of a probe's columns."""
    return probe.unpivot(key, [c for c in probe.columns if c not in key], "attr", "level")


def merge_residuals(reports: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """(key, attr, level): the highest level that the usable reports give."""
    usable = reports.where(~F.coalesce(F.col(status), F.lit("")).isin("unavailable", "no_artifacts"))
    return usable.groupBy(*key, "attr").agg(F.max("level").alias("level"))


def combine_residuals(metadata: DataFrame, probes: DataFrame, key: list[str], policy: str = "conservative_max") -> DataFrame:
    """(key, attr, level) of declared and probed levels: the higher one, or one of them alone."""
    both = metadata.withColumnRenamed("level", "_m").join(probes.withColumnRenamed("level", "_p"), [*key, "attr"], "full_outer")
    level = {"conservative_max": F.greatest("_m", "_p"), "probe_only": F.coalesce("_p", F.lit(NONE)), "metadata_only": F.coalesce("_m", F.lit(NONE))}[policy]
    return both.select(*key, "attr", level.alias("level"))


PROBES_BY_MODALITY = {"image": ("faces", "persons", "text", "scene"), "video": ("faces", "persons", "text", "scene"), "audio": ("speech", "speakers", "audio_presence"), "timeseries": ("presence", "trajectory", "routine")}


def route_artifacts(artifacts: DataFrame, enabled: tuple[str, ...] | None = None, max_frames: int | None = None) -> DataFrame:
    """One row for each artifact and probe of its modality; other modalities have one row, unavailable.

    With ``max_frames``, frames (INT) says how many frames of an artifact its probes read, that many at the most.
    """
    if max_frames is not None:
        artifacts = artifacts.withColumn("frames", F.least("frames", F.lit(max_frames)))
    probes = F.lit(None)
    for modality, names in PROBES_BY_MODALITY.items():
        on = [n for n in names if enabled is None or n in enabled]
        probes = F.when(F.col("modality") == modality, F.array(*map(F.lit, on)) if on else F.array().cast("array<string>")).otherwise(probes)
    routed = artifacts.withColumn("probe", F.explode_outer(probes))
    return routed.withColumn("status", F.when(F.col("modality").isin(*PROBES_BY_MODALITY), "ok").otherwise("unavailable"))


def artifacts_for(artifacts: DataFrame, pipeline_id: str) -> DataFrame:
    return artifacts.where(F.col("pipeline_id").isNull() | (F.col("pipeline_id") == pipeline_id))
