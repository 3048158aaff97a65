"""Shapes of stored results: compaction, flattening, decisions, keys, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compact_run(df: DataFrame, keep: list[str], lists: dict[str, int], maps: list[str]) -> DataFrame:
    """The columns to keep, lists cut to their first k, empty values of maps dropped."""
    cut = [F.slice(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), 1, k).alias(c) for c, k in lists.items()]
    return df.select(*keep, *cut, *[F.map_filter(m, lambda k, v: v.isNotNull() & (v.cast("string") != "")).alias(m) for m in maps])


def flatten_metrics(df: DataFrame, column: str, prefix: str, most: int = 200) -> DataFrame:
    """Scalar fields of a struct column, nested ones too, as prefixed columns; texts of ``most`` characters or more are left out."""

    def leaves(kind: T.StructType, path: str, name: str) -> list[Column]:
        out = []
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, f"{path}.{f.name}", f"{name}_{f.name}")
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                c = F.col(f"{path}.{f.name}")
                out.append((F.when(F.length(c) < most, c) if isinstance(f.dataType, T.StringType) else c).alias(f"{name}_{f.name}"))
        return out

    return df.select(*[c for c in df.columns if c != column], *leaves(df.schema[column].dataType, column, prefix))


def primary_metric(preference: list[str]) -> Column:
    """struct(name, value) of the first metric in order of preference that is there."""
    return F.coalesce(*[F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value"))) for m in preference])


def residual_of(document: Column, attribute: str) -> Column:
    """An attribute's level text from the shapes in which results hold it."""
    return F.coalesce(*[F.get_json_object(document, f"$.{p}.{attribute}") for p in ("residual_disclosure", "residual", "selected.residual_disclosure", "selected_candidate.residual_disclosure")])


def walk_levels(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, attr, value) of the residual map of a document, one row for each entry."""
    text = F.coalesce(F.get_json_object(document, "$.residual_disclosure"), F.get_json_object(document, "$.residual"))
    return df.select(key, F.explode(F.from_json(text, "map<string,string>")).alias("attr", "value"))


def timing_key(scenario: Column, method: Column, label: Column, replicate: Column, warmup: Column, trace: Column) -> Column:
    part = F.coalesce(F.nullif(label, F.lit("")), F.concat(F.when(warmup, "warmup").otherwise("rep"), replicate.cast("string")))
    return F.concat_ws("|", F.coalesce(scenario.cast("string"), F.lit("")), F.coalesce(method, F.lit("")), part, F.coalesce(trace, F.lit("")))


def boolish(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes", "y", "warmup"), F.lit(False))


def decision_text(document: Column, selected_exists: Column) -> Column:
    """A run's decision from the shapes in which results hold it."""
    at = lambda p: F.nullif(F.get_json_object(document, f"$.{p}"), F.lit(""))
    names = ("decision", "outcome", "status")
    first = F.coalesce(*[at(n) for n in names])
    inner = F.coalesce(*[F.nullif(F.get_json_object(first, f"$.{k}"), F.lit("")) for k in ("decision", "outcome", "status", "action", "label")], F.when(F.get_json_object(first, "$.selected_pipeline_id").isNotNull(), F.lit("select_pipeline")))
    plain = F.when(first.startswith("{"), inner).otherwise(first)
    rest = (
        F.when(at("selected_pipeline_id").isNotNull() | at("selected_candidate").startswith("{") | at("selected").startswith("{"), "select_pipeline")
        .when((at("no_compromise") == "true") | (at("no_selected_pipeline") == "true"), "no_compromise").when(at("error").isNotNull(), "error")
    )
    return F.coalesce(plain, rest, F.when(selected_exists, "select_pipeline").otherwise("unknown"))


def output_label(output_type: Column, schema: Column) -> Column:
    """A short name of an output, the first rung of the ladder that fits."""
    t, s = F.lower(output_type), F.lower(schema)
    return (
        F.when(t.contains("redacted"), "redacted media").when(t.endswith("x-raw") & t.startswith("video"), "raw video").when(t.endswith("x-raw") & t.startswith("image"), "raw image")
        .when(t.startswith("audio"), "audio").when(s.contains("count"), "people count").when(s.contains("occupied"), "occupied or not").when(s.contains("activity"), "activity label").otherwise("derived output")
    )
