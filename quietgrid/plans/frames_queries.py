"""Frames are events: a user is a sample, the event's number modulo 40000 of its user is the frame, purchases are present."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import frames
from .registry import Tables, query

c = F.col
FR = """WITH f AS (SELECT user_id AS sample, event_id, (3 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) + event_id % 2)::BIGINT AS frame, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS present,
 CASE WHEN event_type = 'purchase' THEN 1 + event_id % 3 ELSE 0 END AS count, CASE WHEN value > 60 THEN 1 ELSE 0 END AS guess FROM events)
"""


def framed(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    on = c("event_type") == "purchase"
    return t.events.select(c("user_id").alias("sample"), "event_id", (3 * n + c("event_id") % 2).cast("long").alias("frame"), on.cast("int").alias("present"), F.when(on, 1 + c("event_id") % 3).otherwise(0).alias("count"), (c("value") > 60).cast("int").alias("guess"))


@query("J04_join_frames", FR + "SELECT f.sample, f.frame, f.present, g.guess FROM f JOIN (SELECT sample, frame, guess FROM f WHERE event_id % 3 > 0) g USING (sample, frame)")
def _(t: Tables) -> DataFrame:
    f = framed(t)
    return frames.join_frames(f.select("sample", "frame", "present"), f.where("event_id % 3 > 0").select("sample", "frame", "guess"))


@query("J05_semi_split", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) % 2 = 0)")
def _(t: Tables) -> DataFrame:
    manifest = t.events.groupBy("user_id").agg(F.when(F.count("*") % 2 == 0, "Test").otherwise("train").alias("split"))
    return frames.semi_split(t.events, manifest, "test", "user_id").select("event_id")


@query("P01_filter_split", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def _(t: Tables) -> DataFrame:
    return frames.filter_split(t.orders.withColumnRenamed("o_orderstatus", "split"), "f", 500, ["o_orderkey"]).select("o_orderkey")


@query("J06_dilate_labels", FR + "SELECT event_id, max(present) OVER w AS present, CASE WHEN max(present) OVER w = 1 THEN greatest(count, 1) ELSE 0 END::BIGINT AS count, present AS raw_present FROM f WINDOW w AS (PARTITION BY sample ORDER BY frame RANGE BETWEEN 7 PRECEDING AND 4 FOLLOWING)")
def _(t: Tables) -> DataFrame:
    return frames.dilate_labels(framed(t), 4, 7).select("event_id", "present", c("count").cast("long").alias("count"), "raw_present")


EVENTS = """, e0 AS (SELECT *, CASE WHEN frame > lag(frame) OVER (PARTITION BY sample ORDER BY frame) + 9 THEN 1 ELSE 0 END AS nw FROM f WHERE present = 1), e1 AS (SELECT *, sum(nw) OVER (PARTITION BY sample ORDER BY frame) AS ev FROM e0)
"""


@query("W03_fill_gaps", FR + """, g AS (SELECT *, last_value(CASE WHEN present = 1 THEN frame END IGNORE NULLS) OVER (PARTITION BY sample ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
 first_value(CASE WHEN present = 1 THEN frame END IGNORE NULLS) OVER (PARTITION BY sample ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM f) SELECT event_id, CASE WHEN a - b <= 8 THEN 1 ELSE present END AS present FROM g""")
def _(t: Tables) -> DataFrame:
    return frames.fill_gaps(framed(t), 8).select("event_id", "present")


@query("W04_drop_short_runs", FR + """, i AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY frame) - row_number() OVER (PARTITION BY sample, present ORDER BY frame) AS isl FROM f), s AS (SELECT *, count(*) OVER (PARTITION BY sample, present, isl) AS n FROM i)
SELECT event_id, CASE WHEN present = 1 AND n >= 2 THEN 1 ELSE 0 END AS present, CASE WHEN present = 1 AND n >= 2 THEN greatest(count, 1) ELSE 0 END::BIGINT AS count FROM s""")
def _(t: Tables) -> DataFrame:
    return frames.drop_short_runs(framed(t), 2).select("event_id", "present", c("count").cast("long").alias("count"))


@query("W05_presence_events", FR + EVENTS + "SELECT sample, min(frame) AS event_start, max(frame) AS event_end, max(frame) - min(frame) + 1 AS duration, count(*) AS rows, max(count)::BIGINT AS max_count FROM e1 GROUP BY sample, ev")
def _(t: Tables) -> DataFrame:
    return frames.presence_events(framed(t), 9).withColumn("max_count", c("max_count").cast("long"))


@query("W06_contiguous_events", FR.replace("3 * (row", "(row").replace("+ event_id % 2", "") + EVENTS.replace("+ 9", "+ 1") + "SELECT sample, min(frame) AS event_start, max(frame) AS event_end, count(*) AS rows FROM e1 GROUP BY sample, ev")
def _(t: Tables) -> DataFrame:
    f = framed(t).withColumn("frame", F.row_number().over(Window.partitionBy("sample").orderBy("frame")).cast("long") - 1)
    return frames.presence_events(f, 1).select("sample", "event_start", "event_end", "rows")


def _ordered(present: str, name: str, number: str) -> str:
    events = EVENTS.replace("e1 AS", f"{name}1 AS").replace("e0", f"{name}0") if present == "present" else EVENTS.replace("e1 AS", f"{name}1 AS").replace("e0", f"{name}0").replace("present = 1", f"{present} = 1")
    return events + f", {name} AS (SELECT sample, min(frame) AS a, max(frame) AS b, row_number() OVER (PARTITION BY sample ORDER BY min(frame), max(frame)) AS {number} FROM {name}1 GROUP BY sample, ev)"


@query("J07_match_events", FR.replace("WITH f", "WITH RECURSIVE f", 1) + _ordered("present", "tr", "ti") + _ordered("guess", "pr", "pi") + """, o AS (SELECT pr.sample, pi, ti, least(pr.b, tr.b + 2) - greatest(pr.a, tr.a - 2) + 1 AS o FROM pr JOIN tr USING (sample)), q AS (SELECT * FROM o WHERE o > 0),
n AS (SELECT coalesce(x.sample, y.sample) AS sample, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np FROM (SELECT sample, count(*) AS nt FROM tr GROUP BY 1) x FULL JOIN (SELECT sample, count(*) AS np FROM pr GROUP BY 1) y ON x.sample = y.sample),
g(sample, pi, used) AS (SELECT sample, 0::BIGINT, []::BIGINT[] FROM n UNION ALL SELECT g.sample, g.pi + 1, CASE WHEN h.ti IS NULL THEN g.used ELSE list_append(g.used, h.ti) END FROM g JOIN n USING (sample), LATERAL (SELECT min_by(ti, (-o, ti)) AS ti FROM q WHERE q.sample = g.sample AND q.pi = g.pi + 1 AND NOT list_contains(g.used, ti)) h WHERE g.pi < n.np),
z AS (SELECT sample, nt, np, max(len(used))::BIGINT AS tp FROM g JOIN n USING (sample) GROUP BY ALL)
SELECT sample, tp, np - tp AS fp, nt - tp AS fn, coalesce(tp / nullif(np, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(nt, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(np + nt, 0)::DOUBLE, 0) AS f1, coalesce(5 * tp / nullif(np + 4 * nt, 0)::DOUBLE, 0) AS f2 FROM z""")
def _(t: Tables) -> DataFrame:
    f = framed(t)
    return frames.match_events(frames.presence_events(f, 9), frames.presence_events(f.withColumn("present", c("guess")), 9), 2)


@query("J08_align_truth", FR + ", t AS (SELECT sample, frame, present FROM f WHERE sample % 3 > 0 AND event_id % 2 = 0) SELECT f.event_id, coalesce(t.present, 0) AS truth FROM f LEFT JOIN t USING (sample, frame) WHERE sample IN (SELECT sample FROM t)")
def _(t: Tables) -> DataFrame:
    f = framed(t)
    return frames.align_truth(f.drop("present"), f.where("sample % 3 > 0 and event_id % 2 = 0").select("sample", "frame", "present")).select("event_id", "truth")


@query("J21_label_windows", """WITH w AS (SELECT o_orderkey AS sample, i AS win, i * 10 AS s, i * 10 + 19 AS e FROM orders, range(0, 4) r(i)), v AS (SELECT l_orderkey AS sample, min(CAST(l_quantity AS BIGINT)) AS s, min(CAST(l_quantity AS BIGINT)) + 6 AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT w.sample, win::INT AS window, CASE WHEN v.s IS NOT NULL AND greatest(0, least(w.e, v.e) - greatest(w.s, v.s) + 1) / 20.0::DOUBLE >= 0.10 THEN 'fall' ELSE 'nonfall' END AS label FROM w LEFT JOIN v USING (sample)""")
def _(t: Tables) -> DataFrame:
    w = t.orders.select(c("o_orderkey").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("window")).withColumns({"start": c("window") * 10, "end": c("window") * 10 + 19})
    q = F.min(c("l_quantity").cast("long"))
    v = t.lineitem.where("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("sample")).agg(q.alias("start"), (q + 6).alias("end"))
    return frames.label_windows(w, v).select("sample", "window", "label")


@query("W09_sequence_windows", "SELECT o_orderkey, unnest(list_sort(list_distinct(list_concat(range(0, greatest(n - 16, 0) + 1, 8), [greatest(n - 16, 0)]))))::INT AS start FROM (SELECT o_orderkey, o_custkey % 90 AS n FROM orders)")
def _(t: Tables) -> DataFrame:
    return frames.sequence_windows(t.orders.select("o_orderkey", (c("o_custkey") % 90).alias("n")), "n", 16, 8).select("o_orderkey", "start")


@query("A15_eventize_clips", FR + "SELECT sample, sum(present)::BIGINT AS positives, max(count)::DOUBLE AS count, CASE WHEN sum(present) >= 12 THEN 1 ELSE 0 END AS present FROM f GROUP BY sample")
def _(t: Tables) -> DataFrame:
    return frames.eventize_clips(framed(t), 12)


@query("A16_recompute_from_boxes", """WITH b AS (SELECT event_id, list_filter([{'w': value, 'c': 0.9::DOUBLE}, {'w': value / 2, 'c': 0.4::DOUBLE}, {'w': 3.0::DOUBLE, 'c': (event_id % 10) / 10.0::DOUBLE}], lambda x: x.c >= 0.4 AND x.w * 10 >= 40) AS k FROM events)
SELECT event_id, len(k)::INT AS count, CASE WHEN len(k) > 0 THEN 1 ELSE 0 END AS present, coalesce(list_max(list_transform(k, lambda x: x.c)), 0)::DOUBLE AS max_conf FROM b""")
def _(t: Tables) -> DataFrame:
    box = lambda w, conf: F.struct(F.array(F.lit(0.0), F.lit(0.0), w, F.lit(10.0)).alias("xyxy"), conf.alias("conf"), F.lit(0).alias("class_id"))
    boxes = F.to_json(F.array(box(c("value"), F.lit(0.9)), box(c("value") / 2, F.lit(0.4)), box(F.lit(3.0), c("event_id") % 10 / F.lit(10.0))))
    return frames.recompute_from_boxes(t.events.select("event_id", boxes.alias("boxes_json")), 0.4, 40.0).select("event_id", "count", "present", "max_conf")


@query("P17_crop_plan", """WITH b AS (SELECT l_orderkey, (l_suppkey % 40)::DOUBLE AS x1, (l_linenumber * 3)::DOUBLE AS y1, (l_suppkey % 40 + CAST(l_quantity AS BIGINT))::DOUBLE AS x2, (l_linenumber * 3 + l_partkey % 20)::DOUBLE AS y2 FROM lineitem),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2) AS r FROM b)
SELECT l_orderkey, round(greatest(0, x1 - 0.1::DOUBLE * (x2 - x1)), 6) AS x1, round(least(64, x2 + 0.1::DOUBLE * (x2 - x1)), 6) AS x2 FROM m WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    b = t.lineitem.select("l_orderkey", (c("l_suppkey") % 40).cast("double").alias("x1"), (c("l_linenumber") * 3).cast("double").alias("y1"), (c("l_suppkey") % 40 + c("l_quantity").cast("long")).cast("double").alias("x2"), (c("l_linenumber") * 3 + c("l_partkey") % 20).cast("double").alias("y2"))
    return frames.crop_plan(b, ["l_orderkey"], 64, 48).select("l_orderkey", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query("F20_semantic_summary", """SELECT event_id, 1 + (event_id % 3) + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n_labels, greatest(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END + event_id % 3, event_id % 4)::INT AS people, round(value / 500, 6) AS confidence FROM events""")
def _(t: Tables) -> DataFrame:
    p = F.when(c("event_type") == "view", F.array(F.lit("Person"), F.lit("cat"))).otherwise(F.array(F.lit("cat")))
    df = t.events.select("event_id", p.alias("labels"), F.array(F.struct(F.lit("dog").alias("label"), (c("value") / 500).alias("conf"))).alias("detections"), F.create_map(F.lit("person"), (c("event_id") % 3).cast("int")).alias("counts"), (c("event_id") % 4).cast("int").alias("count"), F.lit(None).cast("boolean").alias("occupied"))
    s = frames.semantic_summary(df)
    return s.select("event_id", (F.size("all_labels") - 1).cast("long").alias("n_labels"), "people", F.round("confidence", 6).alias("confidence"))
