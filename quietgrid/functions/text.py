"""Text columns: redaction, intents, label names, identifiers, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIVE = ("1", "true", "yes", "positive", "pos")
NEGATIVE = ("0", "false", "no", "negative", "neg", "none", "normal", "nonfall", "non_fall")
MISSING = ("", "nan", "none", "null")


def redact_text(text: Column) -> Column:
    """Numbers of two digits or more, then pairs of capitalised words, are replaced by tags."""
    return F.regexp_replace(F.regexp_replace(text, r"\b\d{2,}\b", "[NUMBER]"), r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", "[NAME]")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9_']+"), F.lit(0))


def match_intent(text: Column, intents: dict[str, tuple[str, ...]]) -> Column:
    """struct(intent, keyword, confidence): the first intent, and its first keyword, whose tokens all stand in the text."""
    tokens = word_tokens(F.coalesce(text, F.lit("")))
    found = F.lit(None)
    for name, keywords in reversed(intents.items()):
        for k in reversed(keywords):
            hit = F.size(F.array_except(word_tokens(F.lit(k)), tokens)) == 0
            found = F.when(hit, F.struct(F.lit(name).alias("intent"), F.lit(k.lower()).alias("keyword"), F.lit(0.9).alias("confidence"))).otherwise(found)
    return F.coalesce(found, F.struct(F.lit(None).cast("string").alias("intent"), F.lit(None).cast("string").alias("keyword"), F.lit(0.0).alias("confidence")))


def norm_label(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^a-z0-9_.]+", "_")
    return F.btrim(s, F.lit("_"))


def label_binary(text: Column, positive_terms: tuple[str, ...]) -> Column:
    s = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    some = F.lit(False)
    for term in positive_terms:
        some = some | s.contains(term)
    return F.when(s.isin(*POSITIVE), 1).when(s.isin(*NEGATIVE), 0).otherwise(some.cast("int"))


def same_answer(a: Column, b: Column) -> Column:
    """Answers that differ only by case, spacing and trailing dots are the same."""
    clean = lambda c: F.rtrim(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")), F.lit("."))
    return clean(a) == clean(b)


def format_ms(ms: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``; null and negative give an empty text."""
    total = F.bround(ms.cast("long") / 1000.0, 0).cast("long")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    text = F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(ms.isNull() | (ms < 0), "").otherwise(text)


# What a text must contain for each task, in order.
TASK_WORDS = (
    ("fall_detection", ("fall", "le2i", "pose_keypoints", "fall_or_safety_event", "raw_video_stream")),
    ("adl_recognition", ("youhome", "adl", "av_manifest", "youhome_av", "activity_label")),
    ("domestic_sound_monitoring", ("chime", "chimehome", "domestic_audio", "home_audio", "sound_event", "audio_waveform", "speech_removed", "decibel")),
    ("visitor_presence_detection", ("chokepoint", "visitor", "occupancy", "object_detections", "room_occupied", "raw_image_frame", "redacted_image_frame")),
)


def infer_task(text: Column) -> Column:
    s, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("")
    for task, terms in reversed(TASK_WORDS):
        out = F.when(s.rlike("|".join(terms)), task).otherwise(out)
    return out


def safe_id(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), F.lit("_"))


def group_id(name: Column) -> Column:
    """A sample's name without its camera suffix."""
    return F.regexp_replace(name, r"[._]C\d+$", "")


def last_number(name: Column) -> Column:
    return F.element_at(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), -1).try_cast("long")


def clean_path(path: Column, root: str) -> Column:
    """Blank-like paths are null; relative ones are joined to the root."""
    p = F.when(~F.lower(F.trim(path)).isin(*MISSING), F.trim(path))
    return F.when(p.startswith("/"), p).otherwise(F.concat_ws("/", F.lit(root), p)) if root else p


def fingerprint(content: Column) -> Column:
    """First twelve characters of the SHA-1 of a column's text, stable across runs."""
    return F.substring(F.sha1(content.cast("string").cast("binary")), 1, 12)
