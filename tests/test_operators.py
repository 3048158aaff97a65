from __future__ import annotations

from pyspark.sql import functions as F

from quietgrid.functions import caps, risk, text
from quietgrid.operators import frames, observe, pacing, probes, rules, select, stages, survey


def test_rate_limit_keeps_first_and_third(spark):
    df = spark.createDataFrame([("a", 1000, 1), ("a", 1200, 2), ("a", 1600, 3), ("a", None, 4)], "k string, ms long, i long")
    assert sorted(r.i for r in pacing.rate_limit(df, "k", "ms", 500, "i").collect()) == [1, 3, 4]


def test_redaction_tags(spark):
    out = spark.range(1).select(text.redact_text(F.lit("Alice Smith said code 12345")).alias("t")).first().t
    assert out == "[NAME] said code [NUMBER]"


def test_person_and_face_count(spark):
    df = spark.createDataFrame([([("person", 0.9), ("face", 0.8), ("dog", 0.7)], {})], "annotations array<struct<label:string,confidence:double>>, readings map<string,double>")
    row = observe.derive_occupancy(df, binary=True).first()
    assert row["count"] == 2 and row.occupied


def test_count_by_label(spark):
    df = spark.createDataFrame([("speech",), ("speech",), ("alarm",), (None,)], "label string")
    assert {r.label: r.n for r in observe.count_by_label(df, [], F.col("label")).collect()} == {"speech": 2, "alarm": 1, "unknown": 1}


def test_presence_probe(spark):
    df = spark.createDataFrame([("s", 0), ("s", 2), ("s", 3)], "k string, n int")
    row = probes.probe_presence(df, ["k"], F.col("n"), F.lit(None).cast("boolean")).first()
    assert (row.aggregate_presence, row.co_presence) == (3, 3)


def test_events_partition_positives(spark):
    f = spark.createDataFrame([("s", i, int(i in (2, 3, 4, 9, 20)), 1) for i in range(25)], "sample string, frame long, present int, count int")
    events = frames.presence_events(f, 5)
    assert sum(r["rows"] for r in events.collect()) == 5
    assert sorted((r.event_start, r.event_end) for r in events.collect()) == [(2, 9), (20, 20)]


def test_greedy_matching_takes_largest_overlap_once(spark):
    true = spark.createDataFrame([("s", 0, 9), ("s", 20, 29), ("u", 0, 5)], "sample string, event_start long, event_end long")
    pred = spark.createDataFrame([("s", 0, 24), ("s", 5, 9), ("s", 40, 41), ("v", 1, 2)], "sample string, event_start long, event_end long")
    got = {r.sample: (r.tp, r.fp, r.fn) for r in frames.match_events(true, pred).collect()}
    assert got == {"s": (1, 2, 1), "u": (0, 0, 1), "v": (0, 1, 0)}


def test_pareto_front_is_never_empty(spark):
    df = spark.createDataFrame([("r", 1, 1, 2), ("r", 2, 2, 1), ("r", 3, 2, 2), ("q", 4, 3, 3)], "request string, candidate int, a int, b int")
    assert sorted(r.candidate for r in select.pareto_front(df, "request", "candidate", ["a", "b"]).collect()) == [1, 2, 4]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i % 20, float(i % 5)) for i in range(400)], "p int, v double")
    row = survey.cluster_bootstrap(df, "p", "v", 200).first()
    assert row.low <= row["mean"] <= row.high


def test_splits_hold_every_group_once(spark):
    out = survey.assign_split(spark.range(100).withColumn("s", F.col("id") % 2), "id", {"train": 0.7, "test": 0.3}, 1, "s").collect()
    assert len(out) == 100 and {r.split for r in out} == {"train", "test"} and sum(r.split == "train" for r in out) == 70


def test_levels_never_fall_under_max(spark):
    row = spark.createDataFrame([(1, 3)], "a int, b int").select(risk.risk_max(F.col("a"), F.col("b")).alias("m"), risk.norm_risk(F.lit("low_to_medium")).alias("n")).first()
    assert row.m == 3 and row.n == "medium"


def test_stages_append_history_and_reject_unknown(spark):
    df = spark.createDataFrame([(1, [("person", 0.9)], {"value": 2.0}), (2, [("cat", 0.9)], {"value": 0.0})], "id int, annotations array<struct<label:string,confidence:double>>, readings map<string,double>")
    out = stages.run_stages(df, [("op.source", {}), ("op.trigger_gate", {"condition": "annotation:person"}), ("op.occupancy_deriver", {})]).collect()
    assert [r.id for r in out] == [1] and out[0].process == ["op.trigger_gate", "op.occupancy_deriver"]
    try:
        stages.apply_stage(df, "op.none")
        raise AssertionError("an unknown operator must raise")
    except KeyError:
        pass


def test_every_data_operator_is_registered(spark):
    a = F.array(F.struct(F.lit("person").alias("label"), F.lit(0.9).alias("confidence")))
    df = spark.range(2).select("id", F.lit("k").alias("source_id"), (F.col("id") * 1000).alias("timestamp_ms"), F.col("id").alias("item_id"), F.lit(1.0).alias("value"), a.alias("annotations"), F.create_map(F.lit("count"), F.lit(2.0)).alias("readings"), F.lit("Alice Smith said turn on 12345").alias("transcript"), F.array(F.lit(0.05), F.lit(-0.05)).cast("array<float>").alias("samples"), F.create_map(F.lit("visual"), F.lit("raw")).alias("components"), F.create_map(F.lit("x"), F.lit("y")).alias("properties"), F.array(F.lit("glass_break")).alias("labels"), F.lit(None).cast("boolean").alias("fallen"), F.lit(1).alias("people"), F.lit("click").alias("label"), F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("sample_id"), F.col("id").alias("frame_index"), F.lit(1).alias("x1"), F.lit(2).alias("y1"), F.lit(3).alias("x2"), F.lit(4).alias("y2"))
    params = {"op.sample": {"period_ms": 5000}, "op.window": {"window_ms": 1000}}
    rows = {o: stages.apply_stage(df, o, **params.get(o, {})).collect() for o in stages.REGISTRY}
    assert len(rows) == 24 and not rows["op.drop_discard"] and len(rows["op.sample"]) == 1 and rows["op.source"] == df.collect()
    assert rows["op.join_fuse"][0].fused.labels == ["person"] and rows["op.route_publish"][0].published_to is None
    assert rows["op.schema_adapter"][0]["count"] == 2 and rows["op.region_select_crop"][0].x2 == 3 and rows["op.region_mask_blur"][0].properties["redacted"] == "true"
    assert rows["op.audio_level_extractor"][0].dbfs < 0 and rows["op.speech_sound_classifier"][0].labels and rows["op.keyword_intent_extractor"][0].intent.intent == "lights_on"
    assert rows["op.speech_content_removal"][0].transcript == "[NAME] said turn on [NUMBER]" and rows["op.youhome_av_adapter"][0].components == {"visual": "raw", "audio": "raw"}
    assert rows["op.av_visual_redact"][0].components == {"visual": "redacted"} and rows["op.av_audio_silence"][0].samples == [0.0, 0.0] and rows["op.av_audio_silence"][0].components["audio"] == "silent"
    assert rows["op.occupancy_deriver"][0]["count"] == 2 and rows["op.activity_event_classifier"][0].activity == "glass_break_or_alarm"
    assert rows["op.aggregate_generalize"][0].total == 2 and rows["op.motion_feature_extractor"][0]["mean"] == 1.0 and rows["op.multimodal_primitive_fuser"][0].labels == ["click", "fused_event"]


def test_rules_and_splits_at_their_edges(spark):
    flows = spark.createDataFrame([(1, ["R"], ["output_to_application"], [], []), (2, [], ["raw_input"], [], [])], "flow int, recipient array<string>, stage array<string>, tags array<string>, transforms array<string>")
    schema = "rule_id string, action string, match string, unless string, required string, forbidden string, transformations array<string>, stages array<string>, tags array<string>, source_type string"
    authored = [("all", "DENY_FLOW", None, None, None, None, [], ["raw_input"], [], None), ("template_x", "DENY_FLOW", "{}", None, None, None, [], [], [], None), ("absent", "DENY_FLOW", '{"recipient": {"noneOf": ["R"]}}', '{"recipient": false}', None, None, [], [], [], None), ("none", "DENY_FLOW", '{"recipient": {"anyOf": []}}', None, None, None, [], [], [], None)]
    conditions, effects = rules.read_rules(spark.createDataFrame(authored, schema))
    got = {r.flow: r.failed for r in rules.evaluate_rules(flows, conditions, effects, "flow", ["recipient"]).collect()}
    assert got == {1: [], 2: ["all"]}
    empty = rules.evaluate_rules(flows, conditions.where("false"), effects.where("false"), "flow", ["recipient"])
    assert all(r.feasible for r in empty.collect())
    two = survey.assign_split(spark.range(2), "id", {"train": 0.7, "valid": 0.1, "test": 0.2}, 7)
    assert {r.split for r in two.collect()} == {"train", "test"} and survey.assign_split(spark.range(1), "id", {"train": 0.7, "test": 0.3}, 7).first().split == "train"


def test_pareto_front_across_blocks(spark):
    rows = [(r, i, (i * 7) % 11, (i * 5) % 13, (i * 3) % 7) for r in (0, 1) for i in range(60 if r else 5)]
    df = spark.createDataFrame(rows, "request int, candidate int, a int, b int, c int")
    got = {(r.request, r.candidate) for r in select.pareto_front(df, "request", "candidate", ["a", "b", "c"], block=8).collect()}
    beats = lambda x, y: all(p <= q for p, q in zip(x[2:], y[2:], strict=True)) and x[2:] != y[2:]
    assert got == {y[:2] for y in rows if not any(x[0] == y[0] and beats(x, y) for x in rows)}


def test_adapters_repackage_only_what_they_may(spark):
    ops = [("op.cam", "*", "", "video/x-raw", "v"), ("op.schema_adapter", "*", "", "application/x-occupancy", "occupancy_count"), ("op.det", "video/x-raw", "", "application/x-detections", ""), ("op.sound", "audio/x-raw", "", "application/x-sound-event-label", "")]
    edges = caps.compatible_edges(spark.createDataFrame(ops, "op string, in_type string, in_schema string, out_type string, out_schema string"))
    got = {(r.a, r.b) for r in edges.collect()}
    assert ("op.det", "op.schema_adapter") in got and ("op.cam", "op.schema_adapter") not in got and ("op.sound", "op.schema_adapter") not in got and ("op.cam", "op.det") in got


def assigned(spark, items, k, m, n):
    blocks = {i: b for i, b, _ in items}
    rows = survey.assign_items(spark.createDataFrame([x[:2] for x in items], "item int, block string"), spark.createDataFrame([(i, u) for i, _, u in items if u], "item int, used long"), spark.range(n).withColumnRenamed("id", "session"), k, m).collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r.place):
        by.setdefault(r.session, []).append(r.item)
    assert len(by) == n and all(len(v) == len(set(v)) for v in by.values())
    assert sorted(r.place for r in rows if r.session == 0) == list(range(1, len(by[0]) + 1))
    return by, blocks


def test_a_dominating_block_leaves_every_session_its_items(spark):
    items = [(i, "big", 0) for i in range(40)] + [(100 + i, f"b{i % 6}", 5) for i in range(18)]
    by, blocks = assigned(spark, items, 4, 1, 30)
    assert all(len(v) == 4 and len({blocks[i] for i in v}) == 4 for v in by.values())
    assert len({i for v in by.values() for i in v}) == 30 + 18  # the big block gives each session another item, the rest is used evenly
    uses = [sum(i in v for v in by.values()) for i in range(100, 118)]
    assert uses == [5] * 18


def test_assignment_relaxes_the_cap_where_blocks_are_few(spark):
    by, blocks = assigned(spark, [(i, "a", i) for i in range(6)] + [(10, "b", 50), (11, None, 0)], 5, 1, 7)
    assert all(len(v) == 5 and {10, 11} <= set(v) for v in by.values())
    by, _ = assigned(spark, [(1, "a", 3), (2, "a", 0)], 5, 1, 4)
    assert all(sorted(v) == [1, 2] for v in by.values())
