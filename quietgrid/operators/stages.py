"""Pipelines of named stages over observations, batch or streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio, text
from . import flows, observe, pacing
from .flows import AV_STEPS

INTENTS = {"lights_on": ("turn on",), "lights_off": ("turn off",), "help": ("help", "call for help")}


def _components(df: DataFrame, step: str) -> DataFrame:
    """``components`` (MAP<STRING, STRING>) after an audio-video step; waveforms change with their component."""
    df = df.withColumn("components", flows.av_flag(F.col("components"), step))
    if step == "op.av_audio_silence" and "samples" in df.columns:
        return df.withColumn("samples", audio.silence(F.col("samples")))
    if step == "op.av_audio_speech_filter" and "samples" in df.columns:
        return df.withColumn("samples", audio.mute_speech(F.col("samples"), 480))
    return df


def _fuse(df: DataFrame, join_type: str = "OR") -> DataFrame:
    """Adds fused: the join type, the sorted labels of the annotations, and the time of the item."""
    labels = F.array_sort(F.array_distinct(F.filter(F.transform("annotations", lambda a: a["label"]), lambda x: x.isNotNull() & (x != ""))))
    return df.withColumn("fused", F.struct(F.lit(join_type).alias("join_type"), labels.alias("labels")))


def _published(df: DataFrame, path: str | None = None, fmt: str = "json") -> DataFrame:
    """Writes the rows where a path is given; they pass on with the place where they were published."""
    if path is not None:
        from ..sources.scans import publish

        publish(df, path, fmt)
    return df.withColumn("published_to", F.lit(path).cast("string"))


def _speech(df: DataFrame, column: str = "transcript", mode: str = "redact_transcript") -> DataFrame:
    if mode == "redact_transcript":
        return df.withColumn(column, text.redact_text(F.col(column)))
    return df.withColumn("samples", {"mute": audio.mute_speech, "reverse": audio.reverse_chunks}[mode](F.col("samples"), 480 if mode == "mute" else 800))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "op.source": lambda df: df,
    "op.sample": lambda df, period_ms, key="source_id", ms="timestamp_ms", tie="item_id": pacing.rate_limit(df, key, ms, period_ms, tie),
    "op.window": lambda df, window_ms, key="source_id", ms="timestamp_ms", value="value": observe.trailing_window(df, key, ms, window_ms, F.col(value)),
    "op.trigger_gate": lambda df, condition="always", min_confidence=0.0: observe.trigger_gate(df, condition, min_confidence),
    "op.join_fuse": _fuse,
    "op.route_publish": _published,
    "op.schema_adapter": lambda df, target_schema="occupancy_count": observe.adapt_occupancy(df) if target_schema in ("occupancy_count", "room_occupied") else observe.adapt_labels(df),
    "op.region_select_crop": lambda df, key=("sample_id", "frame_index"), pad=0, width=640, height=480, label=None: observe.region_union(df, list(key), pad, width, height, label),
    "op.region_mask_blur": lambda df, target="face": df.withColumn("properties", flows.merge_properties(F.col("properties"), F.create_map(F.lit("redacted"), F.lit("true"), F.lit("target"), F.lit(target)))),
    "op.audio_level_extractor": lambda df, rate=16000: df.withColumn("dbfs", audio.rms_level(F.col("samples"))).withColumn("duration_s", audio.duration(F.col("samples"), rate)),
    "op.speech_sound_classifier": lambda df: df.withColumn("labels", audio.sound_labels(audio.rms_level(F.col("samples")), audio.zero_crossings(F.col("samples")))),
    "op.keyword_intent_extractor": lambda df, intents=None, column="transcript": df.withColumn("intent", text.match_intent(F.col(column), intents or INTENTS)),
    "op.speech_content_removal": _speech,
    "op.youhome_av_adapter": lambda df: df.withColumn("components", F.create_map(F.lit("visual"), F.lit("raw"), F.lit("audio"), F.lit("raw"))),
    **{step: (lambda df, step=step: _components(df, step)) for step in AV_STEPS},
    "op.occupancy_deriver": lambda df, threshold=0.5, binary=False: observe.derive_occupancy(df, threshold, binary),
    "op.activity_event_classifier": lambda df, labels="labels", fallen="fallen", people="people": df.withColumn("activity", observe.classify_activity(F.col(labels), F.col(fallen), F.col(people))),
    "op.aggregate_generalize": lambda df, keys=("source_id",), ts="ts", every="hour", label="label": observe.aggregate_generalize(df, list(keys), ts, every, F.col(label)),
    "op.drop_discard": observe.drop_discard,
    "op.motion_feature_extractor": lambda df, key="source_id", order=("timestamp_ms",), value="value": observe.motion_features(df, key, list(order), value),
    "op.multimodal_primitive_fuser": lambda df, ts="ts", seconds=1, label="label": observe.fuse_events(df, ts, seconds, label),
}


def apply_stage(df: DataFrame, operator_id: str, **params: object) -> DataFrame:
    if operator_id not in REGISTRY:
        raise KeyError(f"no operator {operator_id}")
    return REGISTRY[operator_id](df, **params)


def run_stages(df: DataFrame, stages: list[tuple[str, dict]]) -> DataFrame:
    """The stages in order; the source stage is skipped; ``process`` gathers the operators that a row passed, and starts anew after a stage that makes new rows."""
    if "process" not in df.columns:
        df = df.withColumn("process", F.array().cast("array<string>"))
    for operator_id, params in stages:
        if operator_id != "op.source":
            df = apply_stage(df, operator_id, **params)
            before = F.col("process") if "process" in df.columns else F.array().cast("array<string>")
            df = df.withColumn("process", F.array_append(before, F.lit(operator_id)))
    return df
