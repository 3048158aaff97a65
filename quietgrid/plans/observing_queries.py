"""Observations are events: the user is the source, the type is the label, the value is the reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe, pacing, probes
from .registry import Tables, query

c = F.col
PERSON = "CASE WHEN event_type IN ('click','view') THEN 'person' ELSE event_type END"


def observations(t: Tables) -> DataFrame:
    """Events with annotations (clicks and views are persons) and readings."""
    label = F.when(c("event_type").isin("click", "view"), "person").otherwise(c("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    entry = lambda name, v: F.struct(F.lit(name).alias("key"), v.cast("double").alias("value"))
    readings = F.map_from_entries(F.array_compact(F.array(entry("value", c("value")), F.when(k % 3 == 0, entry("count", k % 5)), F.when(k % 4 == 0, entry("motion", k % 2)), F.when(k % 6 == 1, entry("occupied", k % 2)))))
    return t.events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.unix_millis(c("ts").cast("timestamp")).alias("ms"), F.array(F.struct(label.alias("label"), (c("value") / 100).alias("confidence"))).alias("annotations"), readings.alias("readings"))


OBS = f"WITH o AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, {PERSON} AS label, epoch_ms(ts) AS ms FROM events)\n"


@query("P02_trigger_gate", OBS + """SELECT event_id, 'label' AS gate FROM o WHERE label = 'person' AND value / 100 >= 0.5 UNION ALL SELECT event_id, 'value' FROM o WHERE value > 60
UNION ALL SELECT event_id, 'exists' FROM o WHERE k % 4 = 0 UNION ALL SELECT event_id, 'count' FROM o WHERE (CASE WHEN k % 3 = 0 THEN k % 5 ELSE 0 END) <= 1 UNION ALL SELECT event_id, 'always' FROM o""")
def _(t: Tables) -> DataFrame:
    o = observations(t)
    gates = {"label": ("annotation:person", 0.5), "value": ("value > 60", 0.0), "exists": ("data_exists:motion", 0.0), "count": ("count <= 1", 0.0), "always": ("always", 0.0), "never": ("sometimes?", 0.0)}
    parts = [observe.trigger_gate(o, g, least).select("event_id", F.lit(name).alias("gate")) for name, (g, least) in gates.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("P03_drop_discard", "SELECT event_id, value FROM events WHERE false")
def _(t: Tables) -> DataFrame:
    return observe.drop_discard(t.events.select("event_id", "value"))


@query("P08_schema_adapter", OBS + """SELECT event_id, CASE WHEN g IS NULL AND k % 6 = 1 THEN k % 2 ELSE coalesce(nullif(g, 0), CASE WHEN label = 'person' THEN 1 ELSE 0 END) END::INT AS count,
 (CASE WHEN g IS NULL AND k % 6 = 1 THEN k % 2 ELSE coalesce(nullif(g, 0), CASE WHEN label = 'person' THEN 1 ELSE 0 END) END) > 0 AS occupied, [label] AS labels, value / 100 AS confidence
 FROM (SELECT *, nullif(CASE WHEN k % 3 = 0 THEN k % 5 END, 0) AS g FROM o)""")
def _(t: Tables) -> DataFrame:
    return observe.adapt_labels(observe.adapt_occupancy(observations(t))).select("event_id", "count", "occupied", "labels", "confidence")


@query("A01_count_by_label", "SELECT user_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return observe.count_by_label(t.events, ["user_id"], c("event_type"))


@query("A02_aggregate_generalize", "SELECT user_id, bucket, count(*)::BIGINT AS kinds, sum(n)::BIGINT AS total, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, date_trunc('day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    a = observe.aggregate_generalize(t.events, ["user_id"], "ts", "day", c("event_type"))
    return a.select("user_id", c("bucket").cast("timestamp_ntz").alias("bucket"), F.size("counts").cast("long").alias("kinds"), "total", F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["label"], x["n"])), ",").alias("counts"))


@query("A02_loudness", "SELECT event_id, CASE WHEN value - 60 >= -15 THEN 'loud' WHEN value - 60 <= -45 THEN 'quiet' ELSE 'normal' END AS level FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", observe.loudness(c("value") - 60).alias("level"))


@query("A03_derive_occupancy", OBS + """SELECT event_id, CASE WHEN k % 3 = 0 THEN k % 5 WHEN coalesce(nullif(CASE WHEN k % 4 = 0 THEN k % 2 END, 0), nullif(CASE WHEN k % 6 = 1 THEN k % 2 END, 0), value) >= 0.5 THEN 1 ELSE 0 END::INT AS count FROM o""")
def _(t: Tables) -> DataFrame:
    return observe.derive_occupancy(observations(t)).select("event_id", "count")


@query("W01_trailing_window", OBS + "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)")
def _(t: Tables) -> DataFrame:
    w = observe.trailing_window(observations(t), "user_id", "ms", 3_600_000, c("value"))
    return w.select("event_id", F.size("items").cast("long").alias("n"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("W02_rate_limit", OBS + """, r AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM o)
SELECT user_id, event_id FROM (WITH RECURSIVE k AS (SELECT user_id, event_id, ms, i FROM r WHERE i = 1
 UNION ALL SELECT n.user_id, n.event_id, n.ms, n.i FROM k, LATERAL (SELECT * FROM r WHERE r.user_id = k.user_id AND r.ms >= k.ms + 21600000 ORDER BY i LIMIT 1) n) SELECT user_id, event_id FROM k)""")
def _(t: Tables) -> DataFrame:
    return pacing.rate_limit(observations(t), "user_id", "ms", 21_600_000, "event_id").select("user_id", "event_id")


@query("W10_stride_frames", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 4 = 0 AND n < 32")
def _(t: Tables) -> DataFrame:
    return observe.stride_rows(t.events, "user_id", ["ts", "event_id"], 4, 8).select("event_id")


@query("W11_sample_evenly", """WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events)
SELECT event_id FROM n WHERE list_contains(list_transform(range(0, 5), lambda k: round_even(k * ((m - 1) / 4.0::DOUBLE), 0)::BIGINT), i)""")
def _(t: Tables) -> DataFrame:
    return observe.sample_evenly(t.events, "user_id", ["ts", "event_id"], 5).select("event_id")


@query("F26_classify_activity", OBS + """SELECT event_id, CASE WHEN event_type = 'error' THEN 'glass_break_or_alarm' WHEN event_type = 'signup' THEN 'conversation_or_speech_present' WHEN k % 3 = 0 THEN CASE WHEN value > 50 THEN 'fall' ELSE 'posture_activity' END
 WHEN k % 3 = 1 THEN CASE WHEN label = 'person' THEN 'person_present' ELSE 'no_person' END ELSE 'unknown' END AS activity FROM o""")
def _(t: Tables) -> DataFrame:
    label = F.when(c("event_type") == "error", "alarm_bell").when(c("event_type") == "signup", "speech")
    out = observe.classify_activity(F.array(label), F.when(c("k") % 3 == 0, c("value") > 50), F.when(c("k") % 3 == 1, (c("annotations")[0]["label"] == "person").cast("int")))
    return observations(t).select("event_id", out.alias("activity"))


@query("F37_fuse_events", "SELECT to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS bucket, string_agg(DISTINCT event_type, ',' ORDER BY event_type) || ',fused_event' AS labels, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return observe.fuse_events(t.events, "ts", 900, "event_type").select(c("bucket").cast("timestamp_ntz").alias("bucket"), F.array_join("labels", ",").alias("labels"), "n")


@query("A51_motion_features", """WITH d AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events)
SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(coalesce(avg(d), 0), 6) AS step FROM d GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    return observe.motion_features(t.events, "user_id", ["ts", "event_id"], "value").select("user_id", *[F.round(x, 6).alias(x) for x in ("mean", "sd", "step")])


@query("A52_best_pose", "SELECT label, round(max(s), 6) AS best FROM (SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS s FROM embeddings) GROUP BY label")
def _(t: Tables) -> DataFrame:
    score = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    best = observe.best_pose(t.embeddings.withColumn("s", score).withColumn("pose", F.struct("s", "vec_id")), ["label"], "pose", "s")
    return best.select("label", F.round("pose.s", 6).alias("best"))


@query("A53_region_union", """WITH g AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber * 5) AS a, min(l_suppkey % 40) AS b, max(l_linenumber * 5 + 9) AS c, max(l_suppkey % 40 + 6) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, (CASE WHEN o_custkey % 4 = 0 THEN 5 WHEN n IS NULL THEN 0 ELSE greatest(0, a - 3) END)::INT AS x1, (CASE WHEN o_custkey % 4 = 0 THEN 6 WHEN n IS NULL THEN 0 ELSE greatest(0, b - 3) END)::INT AS y1,
 (CASE WHEN o_custkey % 4 = 0 THEN 7 WHEN n IS NULL THEN 64 ELSE least(64, c + 3) END)::INT AS x2, (CASE WHEN o_custkey % 4 = 0 THEN 8 WHEN n IS NULL THEN 48 ELSE least(48, d + 3) END)::INT AS y2 FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def _(t: Tables) -> DataFrame:
    b = t.lineitem.select("l_orderkey", (c("l_linenumber") * 5).alias("x1"), (c("l_suppkey") % 40).alias("y1"), (c("l_linenumber") * 5 + 9).alias("x2"), (c("l_suppkey") % 40 + 6).alias("y2"), c("l_returnflag").alias("label"))
    static = F.when(c("o_custkey") % 4 == 0, F.struct(*[F.lit(5 + i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))
    frames = t.orders.select(c("o_orderkey").alias("l_orderkey"), static.alias("region"))
    return observe.region_union(b, ["l_orderkey"], 3, 64, 48, label="R", frames=frames).select("l_orderkey", *[c(x).cast("int").alias(x) for x in ("x1", "y1", "x2", "y2")])


@query("A05_probe_presence", OBS + """SELECT user_id, CASE WHEN count(n) > 0 THEN 3 WHEN count(oc) > 0 THEN 2 ELSE 0 END AS aggregate_presence, CASE WHEN count(n) > 0 THEN CASE WHEN max(n) >= 2 THEN 3 ELSE 1 END ELSE 0 END AS co_presence,
 CASE WHEN bool_or(coalesce(n, 0) > 0 OR coalesce(oc, false)) THEN 1 ELSE 0 END AS activity, CASE WHEN bool_or(coalesce(n, 0) > 0 OR coalesce(oc, false)) THEN 1 ELSE 0 END AS location
 FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 AND k % 9 = 0 THEN k % 3 END AS n, CASE WHEN k % 6 = 1 THEN k % 2 = 1 END AS oc FROM o) GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    o = observations(t)
    return probes.probe_presence(o, ["user_id"], F.when((c("user_id") % 2 == 0) & (c("k") % 9 == 0), c("k") % 3), F.when(c("k") % 6 == 1, c("k") % 2 == 1))


@query("A06_probe_trajectory", "SELECT user_id, 2 AS location, CASE WHEN max(n) >= 3 THEN 3 ELSE 2 END AS trajectory, 1 AS identity, CASE WHEN count(*) >= 2 THEN 2 ELSE 0 END AS co_presence FROM (SELECT user_id, event_id % 97 AS track, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return probes.probe_trajectory(t.events.withColumn("track", c("event_id") % 97), ["user_id"], "track")


@query("A07_probe_routine", "SELECT user_id, event_type, CASE WHEN n >= 168 THEN 3 WHEN n >= 24 THEN 2 ELSE 0 END AS activity, CASE WHEN n >= 168 THEN 3 WHEN n >= 24 THEN 2 ELSE 0 END AS aggregate_presence, CASE WHEN n >= 168 THEN 2 WHEN n >= 24 THEN 1 ELSE 0 END AS location FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    return probes.probe_routine(t.events, ["user_id", "event_type"], "ts")


@query("A08_probe_faces", "SELECT l_orderkey, CASE WHEN n <= 1 THEN 1 WHEN n <= 5 THEN 2 ELSE 3 END AS face, CASE WHEN r > 0.03 AND f >= 2 THEN 2 ELSE 1 END AS identity FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS f, max(l_discount) AS r FROM lineitem GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    return probes.probe_faces(t.lineitem, ["l_orderkey"], "l_linenumber", "l_discount")


@query("A09_probe_persons", "SELECT l_orderkey, CASE WHEN r > 0.05 THEN 2 ELSE 1 END AS body_shape, CASE WHEN r > 0.05 THEN 2 ELSE 1 END AS clothing, CASE WHEN n >= 2 THEN 2 ELSE 1 END AS co_presence, CASE WHEN f >= 2 THEN 1 ELSE 0 END AS trajectory, 3 AS aggregate_presence FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS f, max(l_discount) AS r FROM lineitem GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    return probes.probe_persons(t.lineitem, ["l_orderkey"], "l_linenumber", "l_discount")


@query("A10_probe_text", r"SELECT s_nationkey, CASE WHEN n <= 3 THEN 1 WHEN n <= 15 THEN 2 ELSE 3 END AS visible_text, 1 AS identity FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL)")
def _(t: Tables) -> DataFrame:
    return probes.probe_text(t.supplier, ["s_nationkey"], "s_name")


@query("A11_probe_scene", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 2 ELSE 1 END AS location, 1 AS activity, CASE WHEN bool_or(l_returnflag = 'R') THEN 1 ELSE 0 END AS visible_text FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return probes.probe_scene(t.lineitem.withColumn("label", F.when(c("l_returnflag") == "R", "Laptop").otherwise("cup")), ["l_orderkey"], "label")


@query("A12_probe_speech", "SELECT conv_id, CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 1 WHEN n <= 20 THEN 2 ELSE 3 END AS speech_content, CASE WHEN n > 0 THEN 1 ELSE 0 END AS activity FROM (SELECT conv_id, sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9'']+'))) AS n FROM conversations GROUP BY conv_id)")
def _(t: Tables) -> DataFrame:
    return probes.probe_speech(t.conversations, ["conv_id"], "text")


@query("A13_probe_speakers", "SELECT conv_id, CASE WHEN n = 1 THEN 1 ELSE 2 END AS speaker_identity, CASE WHEN n > 1 THEN 3 ELSE 0 END AS co_presence FROM (SELECT conv_id, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id)")
def _(t: Tables) -> DataFrame:
    return probes.probe_speakers(t.conversations, ["conv_id"], "role")


@query("A14_probe_audio_presence", "SELECT user_id, CASE WHEN s > 0 THEN 1 ELSE 0 END AS aggregate_presence, CASE WHEN s >= 60 THEN 2 WHEN s > 0 THEN 1 ELSE 0 END AS activity FROM (SELECT user_id, sum(value) AS s FROM events WHERE event_type = 'error' GROUP BY user_id)")
def _(t: Tables) -> DataFrame:
    return probes.probe_audio_presence(t.events.where("event_type = 'error'"), ["user_id"], "value")


REPORTS = "WITH r AS (SELECT l_orderkey AS id, ['face','gait','activity'][1 + l_partkey % 3] AS attr, CAST(l_quantity AS BIGINT) % 4 AS level, CASE WHEN l_returnflag = 'R' THEN 'unavailable' ELSE 'ok' END AS status, l_linestatus FROM lineitem)\n"


def reports(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, ("face", "gait", "activity"))), (1 + c("l_partkey") % 3).cast("int")).alias("attr"), (c("l_quantity").cast("long") % 4).alias("level"), F.when(c("l_returnflag") == "R", "unavailable").otherwise("ok").alias("status"), "l_linestatus")


@query("A04_merge_residuals", REPORTS + ", p AS (SELECT id, attr, max(level) AS p FROM r WHERE status = 'ok' AND l_linestatus = 'F' GROUP BY ALL), m AS (SELECT id, attr, max(level) AS m FROM r WHERE status = 'ok' AND l_linestatus = 'O' GROUP BY ALL) SELECT coalesce(p.id, m.id) AS id, coalesce(p.attr, m.attr) AS attr, greatest(p, m) AS level FROM p FULL JOIN m ON p.id = m.id AND p.attr = m.attr")
def _(t: Tables) -> DataFrame:
    r = reports(t)
    part = lambda s: probes.merge_residuals(r.where(c("l_linestatus") == s), ["id"])
    return probes.combine_residuals(part("O"), part("F"), ["id"])


ART = "WITH a AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'image' WHEN 'F' THEN 'audio' ELSE 'smell' END AS modality, CASE WHEN o_custkey % 3 > 0 THEN 'p' || o_custkey % 3 END AS pipeline_id FROM orders)\n"


def artifacts(t: Tables) -> DataFrame:
    m = F.when(c("o_orderstatus") == "O", "image").when(c("o_orderstatus") == "F", "audio").otherwise("smell")
    return t.orders.select(c("o_orderkey").alias("id"), m.alias("modality"), F.when(c("o_custkey") % 3 > 0, F.concat(F.lit("p"), c("o_custkey") % 3)).alias("pipeline_id"))


@query("P15_route_artifacts", ART + "SELECT id, unnest(CASE modality WHEN 'image' THEN ['faces','text'] WHEN 'audio' THEN ['speech'] ELSE [NULL] END) AS probe, CASE WHEN modality = 'smell' THEN 'unavailable' ELSE 'ok' END AS status, least(frames, 5)::INT AS frames FROM a JOIN (SELECT o_orderkey, o_custkey % 9 AS frames FROM orders) ON o_orderkey = id")
def _(t: Tables) -> DataFrame:
    given = artifacts(t).join(t.orders.select(c("o_orderkey").alias("id"), (c("o_custkey") % 9).cast("int").alias("frames")), "id")
    return probes.route_artifacts(given, ("faces", "text", "speech"), max_frames=5).select("id", "probe", "status", "frames")


@query("P16_artifacts_for", ART + "SELECT id FROM a WHERE pipeline_id IS NULL OR pipeline_id = 'p1'")
def _(t: Tables) -> DataFrame:
    return probes.artifacts_for(artifacts(t), "p1").select("id")
