"""Scans of manifests, annotations, runs, surveys and contracts; every scan is a Spark reader with a stated schema."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

MEDIA = {"image": ("jpg", "jpeg", "png", "bmp"), "audio": ("wav", "flac", "mp3"), "video": ("mp4", "avi", "mov", "mkv")}
ITEM = "caps struct<semantic_type:string,media_type:string,schema:string,properties:map<string,string>>, data string, annotations array<struct<label:string,confidence:double,bbox:array<double>,value:double,source:string>>, metadata struct<timestamp_ms:bigint,sample_rate:int,source_path:string>"
LISTS = ("records", "rows", "events", "data", "observations")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (blank lines are skipped), a JSON array, or CSV with a header, by suffix."""
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.option("header", True).csv(path)


def read_timeseries(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV with a header; JSON as a list, or as an object whose rows stand under one of LISTS, else the object is one row."""
    if path.endswith((".csv", ".tsv")):
        return spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    df = spark.read.option("multiLine", True).json(path)
    for name in LISTS:
        if name in df.columns:
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).json(path)


def payload_summary(data: Column) -> Column:
    """What stands for a payload: the first 25 keys of an object in order, the length of a list, the length of any other text."""
    keys = F.array_join(F.slice(F.array_sort(F.json_object_keys(data)), 1, 25), ",")
    other = F.format_string("string[%d]", F.length(F.coalesce(data, F.lit(""))))
    return F.coalesce(F.when(data.startswith("{"), F.concat(F.lit("dict["), keys, F.lit("]"))), F.when(data.startswith("["), F.format_string("list[%d]", F.json_array_length(data))), other)


def write_items(df: DataFrame, path: str, include_payload: bool = False) -> None:
    """Items as JSON lines; without the payload its summary stands in its place."""
    out = df if include_payload else df.withColumn("data", payload_summary(F.col("data")))
    out.write.json(path)


def list_media(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """(path, length, type) of the media files under a folder; their content is not read."""
    glob = "*.{" + ",".join(MEDIA[modality]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.lit(modality).alias("type")).orderBy("path")


FRAME_XML = "_number bigint, person array<struct<_id:string,leftEye:struct<_x:double,_y:double>,rightEye:struct<_x:double,_y:double>>>"


def read_frame_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sample, frame, persons, count, present) of each ``<frame number>``; the file's name is the sample."""
    df = spark.read.format("xml").option("rowTag", "frame").schema(FRAME_XML).load(path).select("*", "_metadata.file_name")
    n = F.coalesce(F.size(F.filter("person", lambda p: p.isNotNull())), F.lit(0))
    return df.select(F.regexp_replace("file_name", r"\.xml$", "").alias("sample"), F.col("_number").alias("frame"), F.transform("person", lambda p: p["_id"]).alias("persons"), F.greatest(n, F.lit(0)).alias("count"), (n > 0).cast("int").alias("present"))


# Labels that mean a person, and the attributes and elements of the three dialects.
PERSONS = ("person", "pedestrian", "human", "visitor")
FRAME_KEYS = ("number", "num", "frame", "id", "index", "name")
OBJECTS = ("object", "person", "box", "bndbox", "bbox")


OUTLINES = ("box", "polygon", "points", "object")
TRACK = "_label string, box array<struct<_frame:string,_outside:string>>"
TRACKS = f"array<struct<{TRACK}>>"  # tracks within a track
IMAGE_TAGS = ("frame", "img", "image")


def _text(value: object) -> str:
    return "" if value is None else str(value).lower()


def _below(element: object) -> Iterator[tuple[str, dict]]:
    """(name, attributes and elements) of all elements below one, of an element read as JSON; attributes begin with an underscore."""
    for name, held in element.items() if isinstance(element, dict) else ():
        for x in () if name.startswith("_") else held if isinstance(held, list) else (held,):
            yield name, x if isinstance(x, dict) else {}
            yield from _below(x)


def _image_frames(tag: str, record: object) -> Iterator[tuple[str, int]]:
    """(frame, present) of an element and of those of the same name within it."""
    for own in (record if isinstance(record, dict) else {}, *(x for name, x in _below(record) if name == tag)):
        inner = list(_below(own))
        key = next((k for k in FRAME_KEYS if f"_{k}" in own), None)
        if key:
            yield own[f"_{key}"], int(any(name in OBJECTS for name, _ in inner))
        if tag == "image" and "_id" in own and any(name in OUTLINES and " ".join(_text(x.get("_label")).split()) in PERSONS and _text(x.get("_outside")) not in ("1", "true", "yes") for name, x in inner):
            yield own["_id"], 1


def read_presence_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sample, frame, present) of annotations in any of three dialects; the file's name is the sample.

    Tracks of a person with boxes by frame (``outside`` boxes do not count), images with boxes or outlines, and
    frames with objects of any name.  A frame is present if one of them says so.  Files are read as streams of
    elements, once for each name, so what is held at once is an element and never a file.  Attributes of images and frames
    are values as Spark infers them (007 is 7).
    """

    def elements(tag: str) -> DataFrameReader:
        return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST")

    def frames(tag: str) -> DataFrame:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(n, "" if isinstance(f, bool) else str(f), p) for n, j in zip(batch["file_name"], batch["json"], strict=True) for f, p in _image_frames(tag, json.loads(j))]
                yield pd.DataFrame(found, columns=["file_name", "frame", "present"])

        df = elements(tag).option("singleVariantColumn", "element").load(path).where("element is not null")
        # long texts, as the points of an outline, are none of the values that are asked for
        short = F.regexp_replace(F.to_json("element"), r'"[^"\\]{64,}"', '""')
        return df.select("_metadata.file_name", short.alias("json")).mapInPandas(rows, "file_name string, frame string, present int")

    each = F.array_append(F.coalesce("track", F.array().cast(TRACKS)), F.struct("_label", "box"))
    boxes = elements("track").schema(f"{TRACK}, track {TRACKS}").load(path).select("_metadata.file_name", F.explode(each).alias("t")).select("file_name", "t._label", F.explode("t.box").alias("b"))
    label = F.trim(F.regexp_replace(F.lower(F.coalesce("_label", F.lit(""))), r"\s+", " "))
    outside = F.lower(F.coalesce("b._outside", F.lit(""))).isin("1", "true", "yes")
    found = boxes.select("file_name", F.col("b._frame").alias("frame"), (label.isin(*PERSONS) & ~outside).cast("int").alias("present"))
    for tag in IMAGE_TAGS:
        found = found.unionByName(frames(tag))
    rows = found.select(F.regexp_replace("file_name", r"\.xml$", "").alias("sample"), F.col("frame").try_cast("double").cast("long").alias("frame"), "present")
    return rows.where("frame is not null").groupBy("sample", "frame").agg(F.max("present").alias("present"))


def read_fall_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, fall_start, fall_end, label, rows): the numbers that the first two lines which are not empty begin with, up to a comma and
    cut to whole ones, are start and end; bad or non-positive ones, or fewer than two lines, mean nonfall with zeros.
    A file without any byte gives no row."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    df = spark.read.text(path, wholetext=True).select("_metadata.file_path", lines.alias("l"))
    a, b = (F.trim(F.split_part(F.try_element_at("l", F.lit(k)), F.lit(","), F.lit(1))).try_cast("double").cast("int") for k in (1, 2))
    fall = F.coalesce((a > 0) & (b >= a), F.lit(False))
    return df.select(F.col("file_path").alias("path"), F.when(fall, a).otherwise(0).alias("fall_start"), F.when(fall, b).otherwise(0).alias("fall_end"), F.when(fall, "fall").otherwise("nonfall").alias("label"), F.greatest(F.size("l") - 2, F.lit(0)).alias("rows"))


def read_box_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, class, xc, yc, w, h) of lines with five numbers or more; other lines are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).select("_metadata.file_path", t.alias("t")).where(F.size("t") >= 5)
    num = [F.col("t")[k].try_cast("double").alias(n) for k, n in enumerate(("class", "xc", "yc", "w", "h"))]
    return df.select(F.col("file_path").alias("path"), *num).dropna()


def read_chunk_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta): ``key,value`` lines as a map; values keep their commas, and of a repeated key the last line holds."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains(","))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split(x, ",", 2)[0]).alias("key"), F.trim(F.split(x, ",", 2)[1]).alias("value")))
    df = spark.read.text(path, wholetext=True).select("_metadata.file_path", pairs.alias("e"))
    last = F.filter("e", lambda x, i: ~F.exists(F.slice(F.col("e"), i + 2, F.size("e")), lambda y: y["key"] == x["key"]))
    return df.select(F.col("file_path").alias("path"), F.map_from_entries(last).alias("meta"))


RUN_ROW = "decision string, task string, final_output_type string, final_output_schema string, method_kind string"


def read_run_summary(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, method_id, ..) of documents {scenario: {method: row}}."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,struct<{RUN_ROW.replace(' string', ':string')}>>>").alias("d"))
    by = docs.select(F.explode("d").alias("scenario_id", "m")).select("scenario_id", F.explode("m").alias("method_id", "r"))
    return by.select("scenario_id", "method_id", "r.*").withColumn("method_kind", F.coalesce("method_kind", F.when(F.col("method_id").startswith("ablation:"), "ablation").otherwise("baseline")))


def read_run_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows of ``<scenario>/{baselines,ablations}/<method>/result.json``; ids come from the path."""
    df = spark.read.schema(RUN_ROW).option("multiLine", True).json(f"{root}/*/*/*/result.json").select("*", "_metadata.file_path")
    # a result is a file, or the folder that a job wrote in its place
    part = lambda k: F.regexp_extract("file_path", "([^/]+)/(baselines|ablations)/([^/]+)/result[.]json", k)
    method = F.when(part(2) == "ablations", F.concat(F.lit("ablation:"), part(3))).otherwise(part(3))
    return df.select(part(1).alias("scenario_id"), method.alias("method_id"), F.rtrim(part(2), F.lit("s")).alias("kind"), *[c.split()[0] for c in RUN_ROW.split(", ")])


def union_survey(stores: dict[str, DataFrame], session: str = "session") -> DataFrame:
    """Stores of one survey as one table: session ids carry the store's name, columns that a store lacks are null."""
    out = None
    for name, df in stores.items():
        part = df.withColumn(session, F.concat_ws("::", F.lit(name), session)).withColumn("store", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


BACKFILLED = ("participant_id", "prolific_pid", "prolific_study_id", "prolific_session_id")


def read_survey(spark: SparkSession, folders: list[str], fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(sessions, responses) of several stores, each a folder with ``sessions`` and ``responses``.

    Session ids carry the store's name; what a response lacks of BACKFILLED comes from its session; a store
    without sessions has one for each id of its responses; a store without responses has none.
    """
    sessions, responses = {}, {}
    for i, folder in enumerate(folders):
        name = re.sub(r"[^A-Za-z0-9_]+", "_", folder.rstrip("/").rsplit("/", 1)[-1]) or f"db{i}"
        s, r = (_read_if_there(spark, f"{folder}/{x}", fmt) for x in ("sessions", "responses"))
        if s is None and r is not None:
            s = r.select("session_id").distinct().withColumn("participant_id", F.col("session_id").cast("string"))
        if r is not None:
            r = backfill_sessions(r, s)
            responses[name] = r
        if s is not None:
            sessions[name] = s
    return union_survey(sessions, "session_id"), union_survey(responses, "session_id")


def backfill_sessions(responses: DataFrame, sessions: DataFrame, key: str = "session_id", fields: tuple[str, ...] = BACKFILLED) -> DataFrame:
    """Responses whose empty fields are filled from their session."""
    have = [f for f in fields if f in sessions.columns]
    s = sessions.groupBy(key).agg(*[F.first(F.col(f).cast("string"), ignorenulls=True).alias(f"_{f}") for f in have]) if have else None
    if s is None:
        return responses
    own = lambda f: F.nullif(F.col(f).cast("string"), F.lit("")) if f in responses.columns else F.lit(None).cast("string")
    return responses.join(s, key, "left").withColumns({f: F.coalesce(own(f), F.col(f"_{f}")) for f in have}).drop(*[f"_{f}" for f in have])


def _read_if_there(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


CAP = "struct<media_type:string,semantic_type:string,content_type:string,schema:string>"
CONTRACT = f"id string, label string, category string, operator_kind string, input_caps array<{CAP}>, output_caps array<{CAP}>, utility_capabilities array<string>, composition_notes string"


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each operator of a catalog {operators: [..]}, with its caps as ``type:schema`` texts; a missing file gives no row."""
    text = lambda name: F.transform(F.filter(name, lambda c: F.coalesce(c["media_type"], c["semantic_type"], c["content_type"], c["schema"]).isNotNull()), lambda c: F.concat(F.coalesce(c["media_type"], c["semantic_type"], c["content_type"], F.lit("")), F.lit(":"), F.coalesce(c["schema"], F.lit(""))))
    docs = _read_if_there(spark, path, "text")
    if docs is None:
        return spark.createDataFrame([], f"{CONTRACT}, inputs array<string>, outputs array<string>")
    fields = CONTRACT.replace(" string", ":string").replace(" array", ":array").replace(", ", ",")
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"operators array<struct<{fields}>>").alias("d"))
    return docs.select(F.explode("d.operators").alias("o")).select("o.*").withColumns({"inputs": text("input_caps"), "outputs": text("output_caps")})


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(field, term) of a document {field: [terms]}; a missing file gives no row."""
    if _read_if_there(spark, path, "text") is None:
        return spark.createDataFrame([], "field string, term string")
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("d"))
    return d.select(F.explode("d").alias("field", "terms")).select("field", F.explode("terms").alias("term"))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, task, space, purpose): keys by alias; lists give their first element."""
    v = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path)
    v = v.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("v"))
    one = lambda *names: F.coalesce(*[x for n in names for x in (F.try_variant_get("v", f"$.{n}[0]", "string"), F.try_variant_get("v", f"$.{n}", "string"))])
    return v.select(one("scenario_id", "id", "flow_id").alias("scenario_id"), one("task", "task_id").alias("task"), one("space", "location").alias("space"), one("purpose", "purposes").alias("purpose"))


def read_semantic_outputs(spark: SparkSession, path: str, manifest: DataFrame | None = None, files: tuple[str, ...] = ("preprocessed_json_path", "semantic_json_path"), folders: tuple[str, ...] = ("preprocessed_json_dir", "semantic_dir", "frame_dir")) -> DataFrame:
    """(path, payload) of the JSON artifacts under a path: what stands as an object under data, payload, value or result, else the whole.

    With a manifest its columns come too: a row has the artifacts that its file columns name and those whose
    folder its folder columns name.  Files are found by one listing and joined to the rows by name.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "/+$", "")
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(plain(F.col("_metadata.file_path")).alias("path"), "value")
    inner = [F.get_json_object("value", f"$.{k}") for k in ("data", "payload", "value", "result")]
    t = t.select("path", F.coalesce(*[F.when(x.startswith("{"), x) for x in inner], F.col("value")).alias("payload"))
    if manifest is None:
        return t
    named = [F.struct(plain(F.col(c)).alias("name"), F.lit(k).alias("kind")) for k, cs in ((0, files), (1, folders)) for c in cs if c in manifest.columns]
    rows = manifest.withColumn("_n", F.explode(F.array(*named))).where("_n.name is not null")
    keyed = t.select("*", F.explode(F.array(F.struct(F.col("path").alias("name"), F.lit(0).alias("kind")), F.struct(F.regexp_replace("path", "/[^/]*$", "").alias("name"), F.lit(1).alias("kind")))).alias("_n"))
    return rows.join(keyed.hint("merge"), "_n").drop("_n").distinct()


def publish_union(parts: list[DataFrame], path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Several results as one, with all their columns; what a part lacks is empty."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    publish(out, path, fmt, mode)


def publish(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a result as parquet, json (lines) or csv with a header."""
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
