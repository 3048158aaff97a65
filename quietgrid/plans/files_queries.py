"""Tables written as files of the kinds that the scans read, and read back; streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe, stages
from ..operators.flows import AV_STEPS
from ..sources import manifests, scans
from ..sources.scratch import scratch
from ..streaming import streams
from . import observing_queries  # noqa: F401  (its SQL is used below)
from .registry import SQL, Tables, query

c = F.col


@query("S01_read_manifest", "SELECT doc_id, source, lang FROM documents")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "manifest") + ".jsonl"
    t.documents.select("doc_id", "source", "lang").write.json(path)
    return scans.read_manifest(t.spark, path).select("doc_id", "source", "lang")


@query("S02_read_timeseries", "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "series") + ".tsv"
    t.events.select("event_id", "user_id", "event_type").write.option("header", True).option("sep", "\t").csv(path)
    return scans.read_timeseries(t.spark, path)


@query("S03_items", "SELECT conv_id * 1000 + turn AS ms, CASE WHEN turn % 3 = 0 THEN 'dict[role,text]' WHEN turn % 3 = 1 THEN 'list[2]' ELSE 'string[' || (2 + length(role)) || ']' END AS data FROM conversations")
def _(t: Tables) -> DataFrame:
    kind = c("turn") % 3
    data = F.when(kind == 0, F.to_json(F.struct("text", F.coalesce("role", F.lit("")).alias("role")), {"ignoreNullFields": "false"})).when(kind == 1, F.to_json(F.array("role", F.lit("x")))).otherwise(F.concat(F.lit("r:"), "role"))
    items = t.conversations.select(F.struct(F.lit("text").alias("semantic_type")).alias("caps"), data.alias("data"), F.struct((c("conv_id") * 1000 + c("turn")).alias("timestamp_ms")).alias("metadata"))
    path = scratch(t.spark, "items")
    scans.write_items(items, path)
    return scans.read_items(t.spark, path).select(c("metadata.timestamp_ms").alias("ms"), "data")


def frame_files(t: Tables) -> str:
    """Orders are frames, their lines are persons."""
    eye = F.struct(c("l_partkey").cast("double").alias("_x"), c("l_suppkey").cast("double").alias("_y"))
    persons = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(c("l_linenumber").cast("string").alias("_id"), eye.alias("leftEye"))).alias("person"))
    path = scratch(t.spark, "frames")
    frames = t.orders.select("o_orderkey").join(persons, "o_orderkey", "left").select(c("o_orderkey").alias("_number"), "person")
    frames.repartition(32).write.format("xml").option("rootTag", "dataset").option("rowTag", "frame").save(path)
    return path


FRAMES = "SELECT o_orderkey AS frame, {0}(CASE WHEN n > 0 THEN 1 ELSE 0 END)::INT AS present FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::INT AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query("S05_read_frame_xml", FRAMES.format("coalesce(n, 0) AS count, "))
def _(t: Tables) -> DataFrame:
    return scans.read_frame_xml(t.spark, frame_files(t)).select("frame", "count", "present")


@query("S06_read_presence_xml", FRAMES.format(""))
def _(t: Tables) -> DataFrame:
    return scans.read_presence_xml(t.spark, frame_files(t)).select("frame", "present")


@query("S07_read_fall_annotations", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'nonfall' ELSE 'fall' END AS label, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 10 + n_nationkey END::INT AS fall_start, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 40 + n_regionkey END::INT AS fall_end, 1::INT AS rows FROM nation")
def _(t: Tables) -> DataFrame:
    k = c("n_nationkey")
    first = F.when(k % 3 == 0, F.lit("none")).otherwise(F.concat((10 + k).cast("string"), F.lit(".0,7")))
    path = scratch(t.spark, "falls")
    t.nation.select("n_nationkey", F.concat(first, F.lit("\n\n"), (40 + c("n_regionkey")).cast("string"), F.lit("\n1 2 3")).alias("value")).write.partitionBy("n_nationkey").text(path)
    got = scans.read_fall_annotations(t.spark, f"{path}/*")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), "label", "fall_start", "fall_end", "rows")


@query("S08_read_box_labels", "SELECT l_linenumber::DOUBLE AS class, l_quantity::DOUBLE AS xc, l_discount::DOUBLE AS yc, l_tax::DOUBLE AS w, 0.5::DOUBLE AS h FROM lineitem WHERE l_returnflag <> 'N'")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "boxes")
    line = F.concat_ws(" ", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.when(c("l_returnflag") != "N", "0.5 extra"))
    t.lineitem.select(line.alias("value")).write.text(path)
    return scans.read_box_labels(t.spark, path).select("class", "xc", "yc", "w", "h")


@query("S09_read_chunk_metadata", "SELECT n_nationkey, n_name || ',' || n_regionkey AS name, '2' AS region FROM nation")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "chunks")
    t.nation.select("n_nationkey", F.concat(F.lit("name, "), "n_name", F.lit(","), "n_regionkey", F.lit("\nregion,1\nno pair\nregion,2")).alias("value")).write.partitionBy("n_nationkey").text(path)
    got = scans.read_chunk_metadata(t.spark, f"{path}/*")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), c("meta")["name"].alias("name"), c("meta")["region"].alias("region"))


@query("S17_read_survey_stores", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'one' ELSE 'two' END || '::' || o_orderkey AS session_id, CASE WHEN l_linenumber % 2 = 0 THEN 'own' ELSE o_custkey::VARCHAR END AS participant_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    root = scratch(t.spark, "survey")
    own = F.when(c("l_linenumber") % 2 == 0, "own").otherwise("")
    lines = t.lineitem.select(c("l_orderkey").alias("session_id"), own.alias("participant_id")).join(t.orders.select(c("o_orderkey").alias("session_id"), "o_orderstatus"), "session_id")
    for store, some in (("one", c("o_orderstatus") == "F"), ("two", c("o_orderstatus") != "F")):
        t.orders.where(some).select(c("o_orderkey").alias("session_id"), c("o_custkey").alias("participant_id")).write.json(f"{root}/{store}/sessions")
        lines.where(some).drop("o_orderstatus").write.json(f"{root}/{store}/responses")
    _, responses = scans.read_survey(t.spark, [f"{root}/one", f"{root}/two", f"{root}/missing"])
    return responses.groupBy("session_id", "participant_id").agg(F.count("*").alias("n"))


@query("S20_publish_union", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, NULL::VARCHAR AS priority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey::VARCHAR, NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "published")
    o = t.orders.select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"), c("o_orderpriority").alias("priority"))
    scans.publish_union([o.where("status = 'F'").drop("priority"), o.where("status <> 'F'").drop("status")], path)
    return scans.read_manifest(t.spark, path).select("id", "status", "priority")


@query("S21_read_semantic_outputs", "SELECT n_nationkey, n_name AS name FROM nation")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "outputs")
    k, inner = c("n_nationkey"), F.struct(c("n_name").alias("name"))
    shapes = F.when(k % 3 == 0, F.to_json(F.struct(inner.alias("data")))).when(k % 3 == 1, F.to_json(F.struct(F.array(F.lit(1)).alias("data"), inner.alias("result")))).otherwise(F.to_json(inner))
    docs = t.nation.select("n_nationkey", F.from_json(shapes, "data string, result string, name string").alias("d"))
    named = docs.select("n_nationkey", *[F.try_parse_json(f"d.{x}").alias(x) for x in ("data", "result")], c("d.name").alias("name"))
    named.write.partitionBy("n_nationkey").json(path)
    manifest = t.nation.select("n_nationkey", F.concat(F.lit(path + "/n_nationkey="), "n_nationkey").alias("semantic_dir"))
    got = scans.read_semantic_outputs(t.spark, path, manifest)
    return got.select("n_nationkey", F.get_json_object("payload", "$.name").alias("name"))


def event_stream(t: Tables) -> DataFrame:
    """The events' file as a stream."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")


@query("T01_rate_limit_stream", SQL["W02_rate_limit"])
def _(t: Tables) -> DataFrame:
    rows = event_stream(t).select("event_id", "user_id", F.unix_millis(c("ts").cast("timestamp")).alias("ms"))
    path = scratch(t.spark, "limited")
    streams.publish_stream(streams.rate_limit_stream(rows, "user_id", "ms", 21_600_000, "event_id"), path, path + "-log").awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "user_id")


@query("T02_trailing_stream", """WITH e AS (SELECT event_id, user_id, epoch_ms(ts) AS ms FROM events)
SELECT a.event_id, a.user_id, count(*) AS n, sum(b.event_id % 7)::DOUBLE AS total FROM e a JOIN e b ON b.user_id = a.user_id AND b.ms >= a.ms - 86400000 AND (b.ms, b.event_id) <= (a.ms, a.event_id) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    rows = event_stream(t).select("event_id", "user_id", F.unix_millis(c("ts").cast("timestamp")).alias("ms"), (c("event_id") % 7).cast("double").alias("value"))
    path = scratch(t.spark, "trailed")
    streams.publish_stream(streams.trailing_stream(rows, "user_id", "ms", "value", 86_400_000, "event_id"), path, path + "-log").awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "user_id", "n", "total")


@query("T03_gate_stream", "SELECT event_id FROM events WHERE value > 60")
def _(t: Tables) -> DataFrame:
    rows = event_stream(t).select("event_id", F.create_map(F.lit("value"), "value").alias("readings"))
    path = scratch(t.spark, "gated")
    streams.publish_stream(observe.trigger_gate(rows, "value > 60").select("event_id"), path, path + "-log").awaitTermination()
    return t.spark.read.parquet(path).select("event_id")


@query("T04_session_stream", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, epoch_us(min(ts)) AS event_start, epoch_us(max(ts)) + 21600000000 AS event_end, count(*) AS rows FROM s GROUP BY user_id, g""")
def _(t: Tables) -> DataFrame:
    rows = event_stream(t).select("user_id", c("ts").cast("timestamp").alias("ts"))
    path = scratch(t.spark, "sessions")
    streams.table_stream(streams.session_stream(rows, "ts", ["user_id"], "6 hours"), path, path + "-log").awaitTermination()
    return t.spark.read.parquet(path).select("user_id", F.unix_micros("event_start").alias("event_start"), F.unix_micros("event_end").alias("event_end"), "rows")


@query("T05_decide_stream", "SELECT event_id, user_id, min(p_partkey) AS best FROM events JOIN part ON p_size = user_id % 50 + 1 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    contexts = event_stream(t).select("event_id", "user_id", (c("user_id") % 50 + 1).alias("size"))
    candidates = t.part.groupBy(c("p_size").cast("long").alias("size")).agg(F.min("p_partkey").alias("best"))
    path = scratch(t.spark, "decided")
    streams.decide_stream(contexts, candidates, lambda batch, cand: batch.join(cand.hint("merge"), "size"), path, path + "-log").awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "user_id", "best")


@query("T05_switch_stream", """WITH d AS (SELECT event_id, user_id, CASE WHEN p.size IS NULL THEN 'no_compromise' ELSE 'select_pipeline' END AS decision, best FROM events LEFT JOIN (SELECT p_size AS size, min(p_partkey) % 3 AS best FROM part WHERE p_size > 20 GROUP BY 1) p ON p.size = event_id % 50 + 1),
s AS (SELECT *, decision || '>' || coalesce(best::VARCHAR, '') AS sign, lag(decision || '>' || coalesce(best::VARCHAR, '')) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM d)
SELECT user_id, count(*) AS phases, count(*) FILTER (before <> sign) AS switches, count(*) FILTER (decision = 'select_pipeline') AS selects FROM s GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    contexts = event_stream(t).select("event_id", "user_id", (c("event_id") % 50 + 1).alias("size"))
    candidates = t.part.where("p_size > 20").groupBy(c("p_size").cast("long").alias("size")).agg((F.min("p_partkey") % 3).alias("best"))
    decided = contexts.join(candidates.hint("merge"), "size", "left").withColumn("decision", F.when(c("best").isNull(), "no_compromise").otherwise("select_pipeline"))
    sign = F.concat_ws(">", "decision", F.coalesce(c("best").cast("string"), F.lit("")))
    path = scratch(t.spark, "switched")
    streams.update_stream(streams.switch_stream(decided, ["user_id"], "event_id", sign, selects=c("decision") == "select_pipeline"), path, path + "-log").awaitTermination()
    return streams.latest(t.spark.read.parquet(path), ["user_id"])


@query("T06_probe_stream", "SELECT user_id, 3::INT AS aggregate_presence, CASE WHEN max(event_id % 3) >= 2 THEN 3 ELSE 1 END::INT AS co_presence, CASE WHEN count(*) >= 168 THEN 3 WHEN count(*) >= 24 THEN 2 ELSE 0 END::INT AS activity FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    rows = event_stream(t).select("user_id", (c("event_id") % 3).alias("people"))
    path = scratch(t.spark, "probed")
    streams.table_stream(streams.probe_stream(rows, ["user_id"], "people"), path, path + "-log").awaitTermination()
    return t.spark.read.parquet(path)


@query("T07_publish_stream", "SELECT event_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "published")
    streams.publish_stream(event_stream(t).select("event_id", "event_type"), path, path + "-log", "json").awaitTermination()
    return t.spark.read.schema("event_id long, event_type string").json(path)


@query("X02_run_stages", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END::INT AS count, 'op.trigger_gate>op.occupancy_deriver' AS process FROM events WHERE value > 40")
def _(t: Tables) -> DataFrame:
    o = observing_queries.observations(t).withColumn("readings", F.map_filter("readings", lambda k, v: k == "value"))
    gated = stages.run_stages(o, [("op.source", {}), ("op.trigger_gate", {"condition": "value > 40"})])
    out = stages.run_stages(gated.withColumn("readings", F.create_map().cast("map<string,double>")), [("op.occupancy_deriver", {})])
    return out.select("event_id", c("count").cast("int").alias("count"), F.array_join("process", ">").alias("process"))


@query("S10_build_fall_manifest", "SELECT 'Home' || p_size AS scenario, 'v' || p_partkey AS sample_id, p_partkey % 3 > 0 AS has_annotation, CASE WHEN p_partkey % 3 = 0 THEN 'unlabeled' END AS split, CASE WHEN p_partkey % 3 > 0 THEN p_size END::INT AS annotation_rows FROM part")
def _(t: Tables) -> DataFrame:
    at = lambda folder, suffix: F.format_string(f"/d/Home%d/{folder}/v%d.{suffix}", c("p_size").cast("long"), c("p_partkey"))
    size = c("p_size").cast("int")
    notes = t.part.where("p_partkey % 3 > 0").select(at("Annotations", "txt").alias("path"), size.alias("fall_start"), (size + 5).alias("fall_end"), F.lit("fall").alias("label"), size.alias("rows"))
    return manifests.build_fall_manifest(t.part.select(at("Videos", "avi").alias("path")), notes).select("scenario", "sample_id", "has_annotation", "split", "annotation_rows")


@query("S11_build_presence_manifest", "WITH f AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1), i AS (SELECT c_custkey, count(*) AS m FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT 'P' || user_id AS sample, n AS n_xml_frames, p AS n_positive_frames, n - p AS n_negative_frames, coalesce(m, 0) AS n_images, coalesce(m, 0) > 0 AS has_images FROM f LEFT JOIN i ON c_custkey = user_id")
def _(t: Tables) -> DataFrame:
    frames = t.events.select(F.concat(F.lit("P"), "user_id").alias("sample"), (c("event_type") == "purchase").cast("int").alias("present"))
    images = t.orders.select(F.format_string("/r/P%d/%d.jpg", c("o_custkey"), c("o_orderkey")).alias("path"))
    return manifests.build_presence_manifest(frames, images)


@query("S12_build_audio_manifest", "SELECT 'c' || p_partkey AS chunk_id, CASE WHEN p_size % 2 = 0 THEN 'cv' END AS majorityvote, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END::INT AS label_c, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END::INT AS label_v, 0::INT AS label_m, p_size % 5 > 0 AS audio_exists FROM part")
def _(t: Tables) -> DataFrame:
    name = F.concat(F.lit("c"), "p_partkey")
    chunks = t.part.select(name.alias("chunk_id"), F.lit("dev").alias("split"))
    meta = t.part.where("p_size % 2 = 0").select(F.concat(F.lit("/m/"), name, F.lit(".csv")).alias("path"), F.create_map(F.lit("majorityvote"), F.lit("cv")).alias("meta"))
    files = t.part.where("p_size % 5 > 0").select(F.concat(F.lit("/a/"), name, F.lit(".wav")).alias("path"))
    out = manifests.build_audio_manifest(chunks, meta, files)
    return out.select("chunk_id", "majorityvote", *[c(f"label_{x}").cast("int").alias(f"label_{x}") for x in "cvm"], "audio_exists")


@query("S13_build_adl_manifest", """WITH g AS (SELECT c_nationkey AS p, c_mktsegment AS a, count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS i, count(*) FILTER (c_custkey % 3 = 1) AS t FROM customer GROUP BY ALL), r AS (SELECT p, row_number() OVER (ORDER BY md5('13|p' || p), 'p' || p) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT p FROM g))
SELECT 'p' || p || '_' || a || '_s1' AS sample_id, i AS n_images, t AS n_label_files, i + t < n AS has_audio, CASE WHEN m > 1 AND place = m - 1 THEN 'test' WHEN place / m < 0.8::DOUBLE THEN 'train' WHEN place / m < (0.8::DOUBLE + 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM g JOIN r USING (p)""")
def _(t: Tables) -> DataFrame:
    k = c("c_custkey")
    suffix = F.when(k % 3 == 0, "jpg").when(k % 3 == 1, "txt").otherwise("wav")
    files = t.customer.select(F.concat(F.lit("/r/p"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit("/s1/"), k, F.lit("."), suffix).alias("path"))
    return manifests.build_adl_manifest(files).select("sample_id", "n_images", "n_label_files", "has_audio", "split")


@query("S14_repair_manifest", "WITH l AS (SELECT l_orderkey, l_suppkey AS dir, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT o_orderkey AS sample_id, max_by(l_orderkey || '/' || dir, (n, l_orderkey || '/' || dir)) AS frame_dir, coalesce(max(n), 0) AS n_images FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    dir_ = F.concat_ws("/", "l_orderkey", "l_suppkey")
    dirs = t.lineitem.groupBy(c("l_orderkey").alias("sample_id")).agg(F.collect_set(dir_).alias("dirs"))
    df = t.orders.select(c("o_orderkey").alias("sample_id")).join(dirs, "sample_id", "left")
    listing = t.lineitem.groupBy(dir_.alias("dir")).agg(F.sum("l_linenumber").alias("n_images"))
    return manifests.repair_manifest(df, listing).select("sample_id", "frame_dir", "n_images")


@query("S18_read_contracts", "SELECT 'op.' || p_partkey AS id, p_type AS category, 'video:s' || p_size AS inputs FROM part")
def _(t: Tables) -> DataFrame:
    cap = F.array(F.struct(F.lit("video").alias("media_type"), F.concat(F.lit("s"), "p_size").alias("schema")))
    ops = t.part.select("p_brand", F.struct(F.concat(F.lit("op."), "p_partkey").alias("id"), c("p_type").alias("category"), cap.alias("input_caps")).alias("o"))
    path = scratch(t.spark, "contracts")
    ops.groupBy("p_brand").agg(F.collect_list("o").alias("operators")).repartition("p_brand").write.partitionBy("p_brand").json(path)
    got = scans.read_contracts(t.spark, f"{path}/*")
    return got.select("id", "category", F.array_join("inputs", ",").alias("inputs"))


@query("S19_read_scenarios", "SELECT 'n' || n_nationkey AS scenario_id, n_name AS task, CASE WHEN n_regionkey > 1 THEN 'r' || n_regionkey END AS space FROM nation")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "scenarios")
    docs = t.nation.select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("id"), c("n_name").alias("task"), F.when(c("n_regionkey") > 1, F.array(F.concat(F.lit("r"), "n_regionkey"))).alias("location"))
    docs.write.partitionBy("n_nationkey").json(path)
    return scans.read_scenarios(t.spark, f"{path}/*").select("scenario_id", "task", "space")


@query("S04_list_media", "SELECT 'c_nationkey=' || c_nationkey AS folder, sum(strlen(c_name) + 1)::BIGINT AS length, 'audio' AS type FROM customer GROUP BY c_nationkey")
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark, "media")
    named = t.customer.select("c_nationkey", "c_name").repartition("c_nationkey")
    named.write.partitionBy("c_nationkey").option("extension", "wav").csv(path)
    named.write.partitionBy("c_nationkey").mode("append").option("extension", "txt").csv(path)  # no media
    got = scans.list_media(t.spark, path, "audio")
    return got.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "length", "type")


@query("S15_read_run_summary", "SELECT 's' || c_custkey AS scenario_id, m AS method_id, c_mktsegment AS task, CASE WHEN m = 'raw' THEN 'baseline' WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'ablation' END AS method_kind FROM customer, (VALUES ('raw'), ('ablation:x')) v(m)")
def _(t: Tables) -> DataFrame:
    row = lambda kind: F.struct(c("c_mktsegment").alias("task"), kind.alias("method_kind"))
    none = F.lit(None).cast("string")
    methods = F.create_map(F.lit("raw"), row(none), F.lit("ablation:x"), row(F.when(c("c_custkey") % 2 == 0, "own")))
    docs = t.customer.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), "c_custkey"), methods)))).alias("value"))
    path = scratch(t.spark, "summaries")
    docs.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return scans.read_run_summary(t.spark, f"{path}/*").select("scenario_id", "method_id", "task", "method_kind")


@query("S16_read_run_tree", "SELECT 'S' || n_regionkey AS scenario_id, m AS method_id, CASE m WHEN 'raw' THEN 'baseline' ELSE 'ablation' END AS kind, CASE m WHEN 'raw' THEN a ELSE b END AS task FROM (SELECT n_regionkey, min(n_name) AS a, max(n_name) AS b FROM nation GROUP BY 1), (VALUES ('raw'), ('ablation:no_x')) v(m)")
def _(t: Tables) -> DataFrame:
    root = scratch(t.spark, "tree")
    for r in t.region.select("r_regionkey").collect():  # a folder a scenario
        own = t.nation.where(c("n_regionkey") == r.r_regionkey)
        for kind, method, task in (("baselines", "raw", F.min("n_name")), ("ablations", "no_x", F.max("n_name"))):
            own.agg(task.alias("task")).write.json(f"{root}/S{r.r_regionkey}/{kind}/{method}/result.json")
    return scans.read_run_tree(t.spark, root).select("scenario_id", "method_id", "kind", "task")


_STAGE_SQL = """WITH e AS (SELECT *, epoch_ms(ts) AS ms, CASE WHEN event_type IN ('click', 'view') THEN 'person' ELSE event_type END AS label FROM events),
n AS (SELECT count(*) AS n, count(DISTINCT event_id) AS items, count(DISTINCT user_id) AS users, count(DISTINCT user_id || '|' || event_id % 3) AS frames, count(DISTINCT epoch_ms(ts) // 1000) AS seconds, count(DISTINCT user_id || '|' || epoch_ms(ts) // 3600000) AS hours, count(*) FILTER (value > 40) AS gated,
 (SELECT count(*) FROM (__LIMIT__)) AS limited FROM e)
SELECT unnest(['op.source', 'op.sample', 'op.window', 'op.trigger_gate', 'op.join_fuse', 'op.route_publish', 'op.schema_adapter', 'op.region_select_crop', 'op.region_mask_blur', 'op.audio_level_extractor', 'op.speech_sound_classifier', 'op.keyword_intent_extractor', 'op.speech_content_removal', 'op.youhome_av_adapter', 'op.occupancy_deriver', 'op.activity_event_classifier', 'op.aggregate_generalize', 'op.motion_feature_extractor', 'op.multimodal_primitive_fuser']) AS operator_id,
 unnest([n, limited, n, gated, n, n, n, frames, n, n, n, n, n, n, n, n, hours, users, seconds])::BIGINT AS n FROM n""".replace("__LIMIT__", SQL["W02_rate_limit"]).replace("epoch_ms(ts)", "(epoch_us(ts) // 1000)")  # whole milliseconds, seconds and hours are cut, never rounded


@query("X01_apply_stages", _STAGE_SQL)
def _(t: Tables) -> DataFrame:
    """The rows that each operator of the registry makes of the events; those that only pass components on are left to X02."""
    label = F.when(c("event_type").isin("click", "view"), "person").otherwise(c("event_type"))
    found = F.array(F.struct(label.alias("label"), (c("value") / 100).alias("confidence")))
    text = lambda *xs: F.create_map(*map(F.lit, xs))
    df = t.events.select(
        "event_id", c("event_id").alias("item_id"), c("user_id").alias("source_id"), c("user_id").alias("sample_id"), (c("event_id") % 3).alias("frame_index"), F.unix_millis(c("ts").cast("timestamp")).alias("timestamp_ms"), c("ts").cast("timestamp").alias("ts"),
        "value", found.alias("annotations"), F.create_map(F.lit("value"), "value").alias("readings"), label.alias("label"), F.array(label).alias("labels"), F.lit(None).cast("boolean").alias("fallen"), F.lit(1).alias("people"), text("visual", "raw").alias("components"),
        text("x", "y").alias("properties"), F.concat(F.lit("turn on "), "event_type").alias("transcript"), F.array((c("value") / 500).cast("float"), F.lit(-0.05).cast("float")).alias("samples"), F.lit(1).alias("x1"), F.lit(2).alias("y1"), F.lit(3).alias("x2"), F.lit(4).alias("y2"),
    )
    params = {"op.sample": {"period_ms": 21_600_000}, "op.window": {"window_ms": 60_000}, "op.trigger_gate": {"condition": "value > 40"}}
    out = None
    for name in stages.REGISTRY:
        if name not in AV_STEPS and name != "op.drop_discard":  # that one never has rows
            made = stages.apply_stage(df, name, **params.get(name, {}))
            one = made.agg(F.count(F.struct(*made.columns)).alias("n")).select(F.lit(name).alias("operator_id"), "n")
            out = one if out is None else out.unionByName(one)
    return out
