"""Dataset manifests from file listings and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LETTERS, label_vector
from ..operators.survey import assign_split


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def parent(path: Column, up: int = 1) -> Column:
    """The name of the folder ``up`` levels above a file."""
    return F.element_at(F.split(path, "/"), -1 - up)


def build_fall_manifest(videos: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a video with its annotation by scenario folder and stem; without one the split is ``unlabeled``."""
    key = lambda df: df.withColumns({"scenario": parent(F.col("path"), 2), "sample_id": stem(F.col("path"))})
    a = key(annotations).select("scenario", "sample_id", "fall_start", "fall_end", "label", F.col("rows").alias("annotation_rows"))
    out = key(videos).select("scenario", "sample_id", F.col("path").alias("video_path")).join(a, ["scenario", "sample_id"], "left")
    return out.withColumn("has_annotation", F.col("label").isNotNull()).withColumn("split", F.when(F.col("label").isNull(), "unlabeled"))


def build_presence_manifest(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Counts of frames, positives, negatives and images of each sample (frames: sample, present; images: path under the sample's folder)."""
    f = frames.groupBy("sample").agg(F.count("*").alias("n_xml_frames"), F.count_if(F.col("present") == 1).alias("n_positive_frames"), F.count_if(F.col("present") == 0).alias("n_negative_frames"))
    i = images.groupBy(parent(F.col("path")).alias("sample")).agg(F.count("*").alias("n_images"))
    return f.join(i, "sample", "left").fillna(0, ["n_images"]).withColumn("has_images", F.col("n_images") > 0)


def build_audio_manifest(chunks: DataFrame, metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks (chunk_id, split) with their metadata, seven label columns by majority vote, and whether the audio is there."""
    m = metadata.select(stem(F.col("path")).alias("chunk_id"), F.col("meta")["majorityvote"].alias("majorityvote"))
    there = files.select(stem(F.col("path")).alias("chunk_id")).distinct().withColumn("audio_exists", F.lit(True))
    out = chunks.join(m, "chunk_id", "left").join(there, "chunk_id", "left").fillna(False, ["audio_exists"]).withColumn("_v", label_vector(F.col("majorityvote")))
    return out.select("*", *[F.col("_v")[k].alias(f"label_{x}") for k, x in enumerate(LETTERS)]).drop("_v")


SPLITS = {"train": 0.8, "val": 0.1, "test": 0.1}


def build_adl_manifest(files: DataFrame, fractions: dict[str, float] | None = None, seed: int = 13) -> DataFrame:
    """One row for each participant/activity/session folder: images, label files, whether audio and video are there, and the participant's split."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    g = files.groupBy(parent(F.col("path"), 3).alias("participant"), parent(F.col("path"), 2).alias("activity"), parent(F.col("path"), 1).alias("session"))
    out = g.agg(F.count_if(suffix.isin("jpg", "jpeg", "png")).alias("n_images"), F.count_if(suffix == "txt").alias("n_label_files"), F.max(suffix == "wav").alias("has_audio"), F.max(suffix.isin("mp4", "avi")).alias("has_video")).withColumn("sample_id", F.concat_ws("_", "participant", "activity", "session"))
    return out.join(assign_split(out, "participant", fractions or SPLITS, seed).hint("merge"), "participant")


def repair_manifest(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose ``frame_dir`` is the candidate folder (array ``dirs``) with the most images; null and 0 if none has any."""
    each = df.select("sample_id", F.explode("dirs").alias("dir")).join(listing.hint("merge"), "dir")
    best = each.groupBy("sample_id").agg(F.max_by("dir", F.struct("n_images", F.col("dir"))).alias("frame_dir"), F.max("n_images").alias("n_images"))
    return df.drop("frame_dir", "n_images").join(best.hint("merge"), "sample_id", "left").fillna(0, ["n_images"])
