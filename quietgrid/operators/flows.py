"""Flows built from candidates, and the terms that outputs, sources and policies bring with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import first_per
from .sizes import dealt

EMPTY = "array<string>"
# What kind of information an attribute that is disclosed amounts to.
INFERRED = ("identity", "trajectory", "location", "co_presence")
TERMS = {"speech_content": "speech_transcribed", "aggregate_presence": "occupancy_count"}


def terms(*columns: Column) -> Column:
    """Sorted distinct union of term lists; nulls are empty."""
    parts = [F.coalesce(c, F.array().cast(EMPTY)) for c in columns]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != ""))))


def disclosed_terms(vec: Column) -> tuple[Column, Column, Column]:
    """(primitive, interpreted, inferred) information types of the attributes above none."""
    on = F.map_keys(F.map_filter(vec, lambda k, v: v > 0))
    named = F.create_map(*[F.lit(x) for kv in TERMS.items() for x in kv])
    inferred = F.array_sort(F.filter(on, lambda a: a.isin(*INFERRED)))
    interpreted = F.array_sort(F.transform(F.filter(on, lambda a: ~a.isin(*INFERRED)), lambda a: F.coalesce(named[a], a)))
    primitive = F.when(F.array_contains(on, "speech_content"), F.array(F.lit("speech_audio"))).otherwise(F.array().cast(EMPTY))
    return primitive, interpreted, inferred


def content_types(cap_type: Column, schema: Column) -> Column:
    """What an output carries, by its type and schema; something unnamed is output_data."""
    t, s = F.coalesce(cap_type, F.lit("")), F.coalesce(schema, F.lit(""))
    found = F.array_compact(F.array(
        F.when(t.contains("audio"), "audio_content"), F.when(t.contains("image") | s.contains("frame"), "image_content"),
        F.when(s.contains("transcript") | s.contains("intent"), "textual_content"), F.when(t.contains("video") | s.contains("clip"), "video_content"),
    ))
    return F.when((F.size(found) == 0) & (t != ""), F.array(F.lit("output_data"))).otherwise(found)


def build_flows(candidates: DataFrame, requests: DataFrame, environments: DataFrame, request: str, fields: list[str]) -> DataFrame:
    """A flow for each candidate: each field's terms of its environment and request, the information types it discloses, its content types."""
    r = requests.select(request, *[F.col(f).alias(f"_r_{f}") for f in fields])
    e = environments.select(request, *[F.col(f).alias(f"_e_{f}") for f in fields])
    primitive, interpreted, inferred = disclosed_terms(F.col("vec"))
    # what a vector discloses is shorter than the vector, so it is found before the joins
    own = candidates.select(request, "candidate", primitive.alias("primitive"), interpreted.alias("interpreted"), inferred.alias("inferred"), content_types(F.col("output_type"), F.col("output_schema")).alias("content"))
    df = dealt(own, request).join(r.hint("merge"), request).join(e.hint("merge"), request, "left")
    return df.select(request, "candidate", *[terms(F.col(f"_e_{f}"), F.col(f"_r_{f}")).alias(f) for f in fields], "primitive", "interpreted", "inferred", "content")


def path_get(document: Column, path: str) -> Column:
    """The text under a dotted path of a JSON text, null if there is none."""
    return F.get_json_object(document, "$." + path)


def flatten_values(document: Column) -> Column:
    """All scalars of a JSON text, nested ones too, as texts in order."""
    # strings are taken whole from left to right, so nothing inside one is read; a string before a colon is a name
    found = F.regexp_extract_all(document, F.lit(r'"(?:[^"\\]|\\.)*+"(?=\s*:)|("(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|true|false)'), F.lit(1))
    return F.transform(F.filter(found, lambda s: s != ""), lambda s: F.when(s.startswith('"'), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s))


def add_output_terms(have: Column, output_type: Column, retained: Column) -> Column:
    """Terms of an output: derived types do not retain raw data; redacted media are redacted; retained ones say so."""
    more = F.array_compact(F.array(F.when(output_type.startswith("application/"), "no_raw_retention"), F.when(output_type.rlike("redacted|filtered"), "redacted"), F.when(retained, "retained")))
    return F.array_sort(F.array_union(F.coalesce(have, F.array().cast(EMPTY)), more))


def check_required(have: Column, required: Column) -> Column:
    return F.array_sort(F.array_except(required, have))


def check_forbidden(have: Column, forbidden: Column) -> Column:
    return F.array_sort(F.array_intersect(have, forbidden))


def forbidden_transforms(transforms: Column, principles: Column, forbidden: Column) -> Column:
    return F.array_sort(F.array_intersect(F.array_union(transforms, principles), forbidden))


def capability_ok(offered: Column, requested: Column, equivalents: dict[str, tuple[str, ...]]) -> Column:
    """Whether the requested capability, or one that stands for it, is offered; nothing requested is satisfied."""
    ok = F.array_contains(offered, requested)
    for name, others in equivalents.items():
        ok = ok | ((requested == name) & F.arrays_overlap(offered, F.array(*map(F.lit, others))))
    return requested.isNull() | ok


def source_residual(content: Column, primitives: Column, table: dict[str, dict[str, int]], attribute: str) -> Column:
    """Starting level of one attribute: by content type, else by primitives (a mixed source takes the worse of sight and sound); an unknown sensor discloses location and presence a little."""
    of = lambda k: F.lit(table.get(k, {}).get(attribute, 0))
    has = lambda x: F.array_contains(primitives, x)
    visual = F.when(has("video_stream"), of("video_content")).otherwise(of("image_content"))
    by_content = F.lit(None).cast("int")
    for k in table:
        by_content = F.when(content == k, of(k)).otherwise(by_content)
    seen = has("image_frame") | has("video_stream")
    other = F.lit(1 if attribute in ("location", "aggregate_presence") else 0)
    return F.coalesce(by_content, F.when(has("decibel_level") & F.lit("noise_decibel_monitor" in table), of("noise_decibel_monitor")).when(has("audio_waveform") & ~seen, of("audio_content")).when(seen & has("audio_waveform"), F.greatest(visual, of("audio_content"))).when(seen, visual).otherwise(other))


def merge_properties(old: Column, new: Column) -> Column:
    """Maps merged key by key; the new value wins."""
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce(new, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(keep, F.coalesce(new, F.create_map().cast("map<string,string>")))


# Which component each audio-video step changes, and to what.
AV_STEPS = {"op.av_visual_redact": ("visual", "redacted"), "op.av_video_blackout": ("visual", "blackout"), "op.av_audio_speech_filter": ("audio", "filtered"), "op.av_audio_silence": ("audio", "silent")}


def av_flag(components: Column, step: str) -> Column:
    """The component states (map role -> state) after a step; the other component keeps its state."""
    role, state = AV_STEPS[step]
    return merge_properties(components, F.create_map(F.lit(role), F.lit(state)))


def apply_policy(requests: DataFrame, policies: DataFrame, candidates: DataFrame, request: str) -> DataFrame:
    """The candidate of each request's fixed policy (by task and space, else by task): a target type that stands earlier first, roles to avoid last."""
    keyed = requests.join(policies.where("space is not null").select("task", "space", F.col("targets").alias("_a")), ["task", "space"], "left").join(policies.where("space is null").select("task", F.col("targets").alias("_b")), "task", "left")
    df = keyed.select(request, F.coalesce("_a", "_b").alias("targets")).where("targets is not null").join(candidates, request)
    place = F.nullif(F.array_position("targets", F.col("output_type")), F.lit(0))
    return first_per(df.withColumn("type_rank", place).where("type_rank is not null"), [request], [F.asc("type_rank"), F.asc("avoided"), F.asc("candidate")]).drop("place", "targets")


def select_manual(candidates: DataFrame, policies: DataFrame, request: str) -> DataFrame:
    """The candidate that fits a fixed policy best (type rank, schema rank, missing and extra operators, priority, residual, length); a request without one gets a fallback row."""
    df = candidates.join(policies, request)
    rank = lambda names, value: F.coalesce(F.nullif(F.array_position(names, value), F.lit(0)), F.lit(999))
    df = df.withColumns({"type_rank": rank(F.col("targets"), F.col("output_type")), "schema_rank": rank(F.col("schemas"), F.col("output_schema")), "missing": F.size(F.array_except("preferred", "ops")), "extra": F.size(F.array_except("ops", F.array_union("preferred", F.array(F.lit("op.source"), F.lit("op.route_publish")))))})
    best = first_per(df.where("type_rank < 999"), [request], [F.asc(c) for c in ("type_rank", "schema_rank", "missing", "extra", "priority", "residual")] + [F.asc(F.size("ops")), F.asc("candidate")]).select(request, "candidate", F.lit(False).alias("fallback"))
    rest = policies.join(best, request, "left_anti").select(request, F.lit(None).cast(best.schema["candidate"].dataType).alias("candidate"), F.lit(True).alias("fallback"))
    return best.unionByName(rest)
