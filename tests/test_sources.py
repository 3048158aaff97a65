from __future__ import annotations

import json

from quietgrid.sources import scans


def test_manifests_and_series(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"sample_id": "a"}\n\n{"sample_id": "b"}\n')
    (tmp_path / "m.json").write_text('[{"sample_id": "a"}]')
    (tmp_path / "m.csv").write_text("sample_id,split\na,train\n")
    (tmp_path / "s.json").write_text(json.dumps({"records": [{"t": 1}, {"t": 2}]}))
    (tmp_path / "s.tsv").write_text("t\tn\n1\t2\n")
    assert [scans.read_manifest(spark, str(tmp_path / n)).count() for n in ("m.jsonl", "m.json", "m.csv")] == [2, 1, 1]
    assert scans.read_timeseries(spark, str(tmp_path / "s.json")).count() == 2
    assert scans.read_timeseries(spark, str(tmp_path / "s.tsv")).columns == ["t", "n"]


def test_frame_xml(spark, tmp_path):
    (tmp_path / "P1.xml").write_text('<dataset><frame number="1"><person id="7"><leftEye x="1" y="2"/></person></frame><frame number="2"></frame></dataset>')
    rows = {r.frame: r for r in scans.read_frame_xml(spark, str(tmp_path)).collect()}
    assert rows[1]["count"] == 1 and rows[1].present == 1 and rows[1].sample == "P1" and rows[2].present == 0


def test_presence_xml_in_three_dialects(spark, tmp_path):
    (tmp_path / "A.xml").write_text('<a><track label="Person"><box frame="1" outside="0"/><box frame="2" outside="1"/></track><track label="car"><box frame="3"/><box frame="1"/></track></a>')
    (tmp_path / "B.xml").write_text('<a><image id="4" name="x.jpg"><polygon label="visitor"/></image><image id="5"><polygon label="car"/></image><image name="9"/></a>')
    (tmp_path / "C.xml").write_text('<a><frame num="7"><list><object name="thing"/></list></frame><frame number="8"/><frame/></a>')
    got = {(r.sample, r.frame): r.present for r in scans.read_presence_xml(spark, str(tmp_path)).collect()}
    assert got == {("A", 1): 1, ("A", 2): 0, ("A", 3): 0, ("B", 4): 1, ("B", 5): 0, ("B", 9): 0, ("C", 7): 1, ("C", 8): 0}


def test_survey_contracts_and_semantic_manifest(spark, tmp_path):
    (tmp_path / "db one").mkdir()
    (tmp_path / "db one" / "responses").write_text('{"session_id": "s1", "rating": 3}\n')
    sessions, responses = scans.read_survey(spark, [str(tmp_path / "db one")])
    assert [(r.session_id, r.participant_id) for r in sessions.collect()] == [("db_one::s1", "s1")] and responses.first().participant_id == "s1"
    (tmp_path / "c.json").write_text(json.dumps({"operators": [{"id": "op.a", "input_caps": [{"media_type": "m", "schema": "s"}, {}], "output_caps": [{"semantic_type": "t"}]}]}))
    row = scans.read_contracts(spark, str(tmp_path / "c.json")).first()
    assert (row.id, row.inputs, row.outputs) == ("op.a", ["m:s"], ["t:"])
    assert scans.read_contracts(spark, str(tmp_path / "no.json")).count() == scans.read_vocab(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "sem" / "s1").mkdir(parents=True)
    (tmp_path / "sem" / "s1" / "x.json").write_text('{"data": {"k": 1}}')
    (tmp_path / "sem" / "one.json").write_text('{"data": [1], "value": {"k": 2}}')
    manifest = spark.createDataFrame([("a", str(tmp_path / "sem" / "s1"), None), ("b", None, str(tmp_path / "sem" / "one.json")), ("c", None, None)], "sample_id string, semantic_dir string, semantic_json_path string")
    assert {(r.sample_id, r.payload) for r in scans.read_semantic_outputs(spark, str(tmp_path / "sem"), manifest).collect()} == {("a", '{"k":1}'), ("b", '{"k":2}')}


def test_text_annotations(spark, tmp_path):
    for name, content in (("a", "10\n\n20\n1 2 3\n"), ("b", "0\n0\n"), ("c", "\n"), ("d", "48.0,3\n80\n"), ("e", "5\n")):
        (tmp_path / f"{name}.txt").write_text(content)
    got = {r.path[-5]: (r.fall_start, r.fall_end, r.label, r.rows) for r in scans.read_fall_annotations(spark, str(tmp_path)).collect()}
    assert got == {"a": (10, 20, "fall", 1), "b": (0, 0, "nonfall", 0), "c": (0, 0, "nonfall", 0), "d": (48, 80, "fall", 0), "e": (0, 0, "nonfall", 0)}
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes" / "x.txt").write_text("0 0.5 0.5 0.1 0.2\nbad line\n0 1 2\n")
    assert scans.read_box_labels(spark, str(tmp_path / "boxes")).count() == 1
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "x.csv").write_text("b,9\na,1,2\nb,3\n")
    assert scans.read_chunk_metadata(spark, str(tmp_path / "meta")).first().meta == {"a": "1,2", "b": "3"}


def test_runs_scenarios_and_vocabulary(spark, tmp_path):
    (tmp_path / "sum.json").write_text(json.dumps({"S1": {"ablation:x": {"decision": "selected"}, "full": {"decision": "error", "method_kind": "own"}}}))
    assert {(r.method_id, r.method_kind) for r in scans.read_run_summary(spark, str(tmp_path / "sum.json")).collect()} == {("ablation:x", "ablation"), ("full", "own")}
    for kind, m in (("baselines", "raw"), ("ablations", "no_x")):
        p = tmp_path / "tree" / "S1" / kind / m
        p.mkdir(parents=True)
        (p / "result.json").write_text('{"decision": "selected"}')
    assert {(r.scenario_id, r.method_id, r.kind) for r in scans.read_run_tree(spark, str(tmp_path / "tree")).collect()} == {("S1", "raw", "baseline"), ("S1", "ablation:no_x", "ablation")}
    (tmp_path / "v.json").write_text('{"space": ["home", "office"], "purpose": []}')
    assert scans.read_vocab(spark, str(tmp_path / "v.json")).count() == 2
    (tmp_path / "sc.json").write_text('[{"id": "A", "task": "t", "location": ["kitchen"]}, {"scenario_id": "B", "space": "hall"}]')
    assert {(r.scenario_id, r.space) for r in scans.read_scenarios(spark, str(tmp_path / "sc.json")).collect()} == {("A", "kitchen"), ("B", "hall")}
    (tmp_path / "o.json").write_text('{"payload": {"labels": ["x"]}}')
    assert scans.read_semantic_outputs(spark, str(tmp_path / "o.json")).first().payload == '{"labels":["x"]}'


def test_items_media_and_sinks(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"caps": {"semantic_type": "t"}, "data": "abc", "metadata": {"timestamp_ms": 5}}\n')
    items = scans.read_items(spark, str(tmp_path / "i.json"))
    scans.write_items(items, str(tmp_path / "out"))
    assert scans.read_items(spark, str(tmp_path / "out")).first().data == "string[3]"
    (tmp_path / "media" / "sub").mkdir(parents=True)
    (tmp_path / "media" / "sub" / "a.wav").write_bytes(b"12")
    (tmp_path / "media" / "b.txt").write_text("x")
    assert [(r.length, r.type) for r in scans.list_media(spark, str(tmp_path / "media"), "audio").collect()] == [(2, "audio")]
    for fmt in ("parquet", "json", "csv"):
        scans.publish(spark.range(3), str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3
    (tmp_path / "j.json").write_text('{"data": {"b": 1, "a": 2}}\n{"data": [1, 2]}\n')
    scans.write_items(scans.read_items(spark, str(tmp_path / "j.json")), str(tmp_path / "sums"))
    assert {r.data for r in scans.read_items(spark, str(tmp_path / "sums")).collect()} == {"dict[a,b]", "list[2]"}


def test_manifest_builders(spark):
    from quietgrid.sources import manifests

    v = spark.createDataFrame([("/d/Home/Videos/v1.avi",), ("/d/Home/Videos/v2.avi",)], "path string")
    a = spark.createDataFrame([("/d/Home/Annotations/v1.txt", 3, 9, "fall", 20)], "path string, fall_start int, fall_end int, label string, rows int")
    assert {(r.sample_id, r.has_annotation, r.split) for r in manifests.build_fall_manifest(v, a).collect()} == {("v1", True, None), ("v2", False, "unlabeled")}
    f = spark.createDataFrame([("P1", 1), ("P1", 0), ("P2", 0)], "sample string, present int")
    i = spark.createDataFrame([("/r/P1/0.jpg",), ("/r/P1/1.jpg",)], "path string")
    assert {(r.sample, r.n_positive_frames, r.n_images, r.has_images) for r in manifests.build_presence_manifest(f, i).collect()} == {("P1", 1, 2, True), ("P2", 0, 0, False)}
    c = spark.createDataFrame([("c1", "dev"), ("c2", "eva")], "chunk_id string, split string")
    m = spark.createDataFrame([("/m/c1.csv", {"majorityvote": "cv"})], "path string, meta map<string,string>")
    w = spark.createDataFrame([("/a/c1.wav",)], "path string")
    rows = {r.chunk_id: r for r in manifests.build_audio_manifest(c, m, w).collect()}
    assert rows["c1"].label_c == rows["c1"].label_v == 1 and rows["c1"].audio_exists and rows["c2"].label_c == 0 and not rows["c2"].audio_exists
    g = spark.createDataFrame([("/r/p1/cook/s1/a.jpg",), ("/r/p1/cook/s1/a.txt",), ("/r/p1/cook/s1/a.wav",)], "path string")
    row = manifests.build_adl_manifest(g).first()
    assert (row.sample_id, row.n_images, row.n_label_files, row.has_audio, row.has_video, row.split) == ("p1_cook_s1", 1, 1, True, False, "train")
    d = spark.createDataFrame([("x", ["/a", "/b"]), ("y", ["/c"])], "sample_id string, dirs array<string>")
    n = spark.createDataFrame([("/a", 2), ("/b", 5)], "dir string, n_images long")
    assert {(r.sample_id, r.frame_dir, r.n_images) for r in manifests.repair_manifest(d, n).collect()} == {("x", "/b", 5), ("y", None, 0)}
