"""Scalar functions over texts, embeddings (as waveforms of 64 samples) and order lines (as boxes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio, geometry, labels, text
from .registry import Tables, query

c = F.col


@query("F15_redact_text", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\b\d{2,}\b', '[NUMBER]', 'g'), '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b', '[NAME]', 'g') AS redacted FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.redact_text(c("text")).alias("redacted"))


INTENTS = {"lights": ("the light", "of"), "music": ("de la",), "call": ("und",)}


@query("F16_match_intent", r"""
WITH k AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_'']+') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN list_has_all(w, ['the','light']) THEN 'lights' WHEN list_has_all(w, ['of']) THEN 'lights' WHEN list_has_all(w, ['de','la']) THEN 'music' WHEN list_has_all(w, ['und']) THEN 'call' END AS intent,
 CASE WHEN list_has_all(w, ['the','light']) THEN 'the light' WHEN list_has_all(w, ['of']) THEN 'of' WHEN list_has_all(w, ['de','la']) THEN 'de la' WHEN list_has_all(w, ['und']) THEN 'und' END AS keyword,
 CASE WHEN list_has_all(w, ['of']) OR list_has_all(w, ['de','la']) OR list_has_all(w, ['und']) THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM k""")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.match_intent(c("text"), INTENTS).alias("m")).select("conv_id", "turn", "m.*")


@query("F17_label_vector", "SELECT p_partkey, list_transform(['c','m','f','v','p','b','o'], lambda x: CASE WHEN contains(lower(trim(p_type)), x) THEN 1 ELSE 0 END) AS vec FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", labels.label_vector(c("p_type")).alias("vec"))


SYNONYMS = {"c": ("child",), "m": ("error",), "f": ("female",), "v": ("view",), "p": ("purchase",), "b": ("noise",), "o": ("other",)}


@query("F18_pred_vector", """
SELECT event_id, CASE event_type WHEN 'error' THEN [0,1,0,0,0,0,1] WHEN 'view' THEN [0,0,0,1,0,0,0] WHEN 'purchase' THEN [0,0,0,0,1,0,0] WHEN 'click' THEN [1,0,0,0,0,0,0]
 ELSE [0,0,0,0,1,0,0] END AS vec FROM events""")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", labels.pred_vector(F.array("event_type"), SYNONYMS, c("value") - 60).alias("vec"))


@query("F19_norm_label", r"""
SELECT conv_id, turn, trim(regexp_replace(lower(trim(text)), '[^a-z0-9_.]+', '_', 'g'), '_') AS label,
 CASE WHEN contains(lower(trim(role)), 'assist') OR contains(lower(trim(role)), 'sys') THEN 1 ELSE 0 END AS positive FROM conversations""")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.norm_label(c("text")).alias("label"), text.label_binary(c("role"), ("assist", "sys")).alias("positive"))


@query("F21_fingerprint", "SELECT o_orderkey, substr(sha1(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey), 1, 12) AS fingerprint FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.fingerprint(F.concat_ws("|", "o_orderstatus", "o_orderpriority", "o_custkey")).alias("fingerprint"))


AUDIO_SQL = """
WITH a AS (SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS ss,
  list_sum(list_transform(range(1, len(embedding)), lambda i: CASE WHEN (embedding[i] < 0) <> (embedding[i + 1] < 0) THEN 1 ELSE 0 END)) AS z FROM embeddings),
f AS (SELECT vec_id, 20 * log10(greatest(sqrt(ss / n + 1e-12), 1e-12)) AS level, z / (n - 1.0)::DOUBLE AS crossings, n / 16000.0::DOUBLE AS seconds FROM a)
"""


def features(t: Tables) -> DataFrame:
    e = c("embedding")
    return t.embeddings.select("vec_id", audio.rms_level(e).alias("level"), audio.zero_crossings(e).alias("crossings"), audio.duration(e, 16000).alias("seconds"))


@query("F22_audio_features", AUDIO_SQL + "SELECT vec_id, round(level, 6) AS level, round(crossings, 6) AS crossings, seconds FROM f")
def _(t: Tables) -> DataFrame:
    return features(t).select("vec_id", F.round("level", 6).alias("level"), F.round("crossings", 6).alias("crossings"), "seconds")


@query("F23_sound_labels", AUDIO_SQL + """SELECT vec_id, CASE WHEN level < -45 THEN 'silence' ELSE coalesce(nullif(concat_ws(',', CASE WHEN level > -12 THEN 'loud_noise' END,
 CASE WHEN crossings BETWEEN 0.02 AND 0.18 AND level > -45 AND level < -5 THEN 'speech' END, CASE WHEN crossings > 0.22 AND level > -25 THEN 'glass_break_or_alarm' END), ''), 'ambient_sound') END AS labels FROM f""")
def _(t: Tables) -> DataFrame:
    found = audio.sound_labels(c("level"), c("crossings"))
    return features(t).select("vec_id", F.array_join(F.transform(found, lambda x: x["label"]), ",").alias("labels"))


@query("F24_mute_speech", """
WITH f AS (SELECT vec_id, k, list_slice(embedding, k * 16 + 1, k * 16 + 16) AS f FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 16)) AS k FROM embeddings)),
a AS (SELECT *, 20 * log10(greatest(sqrt(list_sum(list_transform(f, lambda x: x::DOUBLE * x::DOUBLE)) / 16 + 1e-12), 1e-12)) AS level, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN (f[i] < 0) <> (f[i + 1] < 0) THEN 1 ELSE 0 END)) / 15.0::DOUBLE AS z FROM f)
SELECT vec_id, round(sum(CASE WHEN z BETWEEN 0.02 AND 0.18 AND level > -45 AND level < -5 THEN 0 ELSE list_sum(list_transform(range(1, 17), lambda i: (k * 16 + i) * f[i]::DOUBLE)) END), 4) AS muted,
 round(sum(list_sum(list_transform(range(1, 17), lambda i: (k * 16 + i) * f[17 - i]::DOUBLE))), 4) AS reversed, 0.0::DOUBLE AS silent FROM a GROUP BY vec_id""")
def _(t: Tables) -> DataFrame:
    e = c("embedding")
    # each sample counts by its place, so one that is muted or moved changes the sum
    total = lambda x: F.round(F.aggregate(F.transform(x, lambda v, i: (i + 1) * v.cast("double")), F.lit(0.0), lambda a, v: a + v), 4)
    return t.embeddings.select("vec_id", total(audio.mute_speech(e, 16)).alias("muted"), total(audio.reverse_chunks(e, 16)).alias("reversed"), total(audio.silence(e)).alias("silent"))


@query("F25_looks_fallen", """
WITH j AS (SELECT vec_id, list_transform(range(0, 20), lambda i: [embedding[3 * i + 1], embedding[3 * i + 2], embedding[3 * i + 3]]) AS js FROM embeddings),
s AS (SELECT vec_id, CASE WHEN len(list_filter(js, lambda x: x[3] > 0.2)) > 0 THEN list_filter(js, lambda x: x[3] > 0.2) ELSE js END AS v FROM j)
SELECT vec_id, (list_max(list_transform(v, lambda x: x[1])) - list_min(list_transform(v, lambda x: x[1]))) > (list_max(list_transform(v, lambda x: x[2])) - list_min(list_transform(v, lambda x: x[2])))::DOUBLE * 1.3 AS fallen FROM s""")
def _(t: Tables) -> DataFrame:
    joints = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.slice("embedding", i * 3 + 1, 3))
    return t.embeddings.select("vec_id", geometry.looks_fallen(joints).alias("fallen"))


@query("F27_norm_box", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x1, l_linenumber::DOUBLE AS y1, (l_suppkey % 60)::DOUBLE AS x2, (l_partkey % 90)::DOUBLE AS y2 FROM lineitem),
s AS (SELECT *, (x2 <= x1 OR y2 <= y1) AS sz FROM b), k AS (SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, CASE WHEN sz THEN x1 + x2 ELSE x2 END AS x2, CASE WHEN sz THEN y1 + y2 ELSE y2 END AS y2 FROM s),
h AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN f THEN x1 * 64 ELSE x1 END AS x1, CASE WHEN f THEN y1 * 48 ELSE y1 END AS y1, CASE WHEN f THEN x2 * 64 ELSE x2 END AS x2, CASE WHEN f THEN y2 * 48 ELSE y2 END AS y2 FROM (SELECT *, greatest(x1, y1, x2, y2) <= 1.5 AS f FROM k)),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(CAST(x1 AS INT), 63)) AS x1, greatest(0, least(CAST(y1 AS INT), 47)) AS y1, greatest(0, least(CAST(x2 AS INT), 64)) AS x2, greatest(0, least(CAST(y2 AS INT), 48)) AS y2 FROM h),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, CASE WHEN x2 <= x1 THEN least(64, x1 + 1) ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN least(48, y1 + 1) ELSE y2 END AS y2 FROM p)
SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area FROM q""")
def _(t: Tables) -> DataFrame:
    box = geometry.norm_box(c("l_quantity"), c("l_linenumber").cast("double"), (c("l_suppkey") % 60).cast("double"), (c("l_partkey") % 90).cast("double"), 64, 48)
    return t.lineitem.withColumn("box", box).select("l_orderkey", "l_linenumber", "l_partkey", "box.*", geometry.box_area(c("box")).alias("area"))


@query("F28_normalize_keypoints", """
WITH j AS (SELECT vec_id, unnest(range(0, 17)) AS joint, embedding FROM embeddings), p AS (SELECT vec_id, joint, embedding[joint + 1]::DOUBLE AS x, embedding[joint + 18]::DOUBLE AS y, embedding[joint + 35]::DOUBLE AS k FROM j),
v AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, greatest(1.0, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2)) AS d FROM p WHERE k > 0.05 GROUP BY vec_id)
SELECT p.vec_id, joint::INT AS joint, round((x - coalesce(cx, 0)) / coalesce(d, 1), 6) AS x, round((y - coalesce(cy, 0)) / coalesce(d, 1), 6) AS y FROM p LEFT JOIN v USING (vec_id)""")
def _(t: Tables) -> DataFrame:
    from ..operators import observe

    e = "embedding"
    long = t.embeddings.select("vec_id", F.posexplode(F.arrays_zip(*[F.slice(e, a, 17).alias(n) for n, a in (("x", 1), ("y", 18), ("k", 35))])).alias("joint", "p")).select("vec_id", "joint", *[c(f"p.{n}").cast("double").alias(n) for n in "xyk"])
    out = observe.normalize_keypoints(long, ["vec_id"], "k")
    return out.select("vec_id", "joint", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("F30_same_answer", r"""
SELECT conv_id, turn, rtrim(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '.') = rtrim(trim(regexp_replace(lower(role || '.'), '\s+', ' ', 'g')), '.') AS is_role,
 rtrim(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '.') = rtrim(trim(regexp_replace(lower('  ' || text || '..'), '\s+', ' ', 'g')), '.') AS is_itself FROM conversations""")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.same_answer(c("text"), F.concat(c("role"), F.lit("."))).alias("is_role"), text.same_answer(c("text"), F.concat(F.lit("  "), "text", F.lit(".."))).alias("is_itself"))


@query("F31_format_ms", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(CAST(floor(l_extendedprice * 100) AS BIGINT) / 1000.0::DOUBLE, 0) AS BIGINT) AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS shown FROM s""")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.format_ms(F.floor(c("l_extendedprice") * 100)).alias("shown"))


@query("F34_infer_task", """
WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Fall-' WHEN 1 THEN 'my_ADL ' WHEN 2 THEN 'home_audio/' WHEN 3 THEN 'visitor' ELSE '' END || event_type AS s FROM events)
SELECT event_id, CASE WHEN contains(lower(s), 'fall') THEN 'fall_detection' WHEN contains(lower(s), 'adl') THEN 'adl_recognition' WHEN contains(lower(s), 'home_audio') THEN 'domestic_sound_monitoring' WHEN contains(lower(s), 'visitor') THEN 'visitor_presence_detection' ELSE '' END AS task FROM x""")
def _(t: Tables) -> DataFrame:
    k = c("event_id") % 6
    s = F.concat(F.when(k == 0, "Fall-").when(k == 1, "my_ADL ").when(k == 2, "home_audio/").when(k == 3, "visitor").otherwise(""), c("event_type"))
    return t.events.select("event_id", text.infer_task(s).alias("task"))


@query("F35_safe_id", r"""
SELECT c_custkey, trim(regexp_replace(c_name || '_C' || c_nationkey, '[^A-Za-z0-9]+', '_', 'g'), '_') AS safe, regexp_replace(c_name || '_C' || c_nationkey, '[._]C\d+$', '') AS grp, c_nationkey::BIGINT AS last FROM customer""")
def _(t: Tables) -> DataFrame:
    name = F.concat("c_name", F.lit("_C"), "c_nationkey")
    return t.customer.select("c_custkey", text.safe_id(name).alias("safe"), text.group_id(name).alias("grp"), text.last_number(name).alias("last"))


@query("F44_clean_path", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN NULL WHEN p_size % 5 = 2 THEN '/abs/' || p_name ELSE 'root/' || p_name END AS path FROM part""")
def _(t: Tables) -> DataFrame:
    k = c("p_size") % 5
    raw = F.when(k == 0, " NaN ").when(k == 1, "").when(k == 2, F.concat(F.lit("/abs/"), "p_name")).otherwise(c("p_name"))
    clean = text.clean_path(raw, "root")
    return t.part.select("p_partkey", F.when(clean != "root", clean).alias("path"))


@query("F46_fit_length", "SELECT vec_id, list_transform(range(1, 81), lambda i: CASE WHEN i <= 64 THEN embedding[i] ELSE 0::FLOAT END) AS longer, embedding[1:10] AS shorter FROM embeddings")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", audio.fit_length(c("embedding"), 80).alias("longer"), audio.fit_length(c("embedding"), 10).alias("shorter"))


@query("K11_resample", "SELECT vec_id, list_transform(range(0, 9), lambda i: embedding[CAST(round_even(i * (63 / 8.0::DOUBLE), 0) AS INT) + 1]) AS points FROM embeddings")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", audio.resample(c("embedding"), 9).alias("points"))
